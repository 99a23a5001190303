"""Cross-entropy difference between two matched word trigram models, held as distributed tables.

A target model is counted over the texts marked as target, a background model over all
texts. Both are word trigram models (words as in ``minhash``: lower-cased runs of letters,
digits and non-ASCII characters) over one vocabulary, the words of the whole corpus plus one
for all others, with the same Witten-Bell interpolation of trigrams, bigrams and add-one word
frequencies. A document's score is the mean over its words of the target's loss minus the
background's loss, in bits: the lower, the nearer to the target. Each text is scored without its
own row's counts in either model, so that no text is judged by a model that has seen it; the
vocabulary stays that of the whole corpus.

The counts grow with the corpus and are never gathered or broadcast. Documents are dealt
into chunks of about ``CHUNK`` bytes by a hash of their id. First a chunk sends its distinct
words, once each with counts, to buckets by hash; a bucket adds up all chunks' counts, numbers
its words, frequent ones first, and answers each chunk. Then a chunk sends its distinct
bigrams and trigrams, as numbers, to the buckets of their contexts, and each is answered
with the corpus' counts of the n-gram and its context's totals and numbers of continuations.
The chunk takes off what each of its texts has added itself, turns the rest into losses and adds
these up by document. A frequent n-gram is one entry a chunk. Words are compared by 64-bit hashes, n-grams exactly by their words' numbers.

There are as many buckets as chunks, and a chunk sends at most ``FAN`` rows of each kind. With more
buckets than that a row covers a range of them: the rows of some neighbouring chunks for one
range meet in a task that adds them up, and sends rows on to the parts of the range; answers take the
same ways back. All levels have about the same number of ways (the root of the number of buckets, at
most ``FAN``), and as many chunks meet, so that a task gets about a chunk's number of entries. So rows grow as
the corpus times the number of levels (one to 2 GB, two to 512 GB, three to 128 TB). The rows of a
level above the last are written to the shared folder.

A context that may have more than ``WIDE`` continuations, by the counts of its words and the size
of the vocabulary, which all chunks know alike, is dealt in parts by its continuations. Each part has
its own bucket, and a chunk that holds the context asks all of them for their totals.

Edge cases: a null text or one without words has no tokens, adds nothing and gets null scores.
Target ids that are null or repeated count once or not at all; repeated documents count each
time, and each is scored with the others counted. Without any other target text the target model
is uniform over the vocabulary. Empty tables
give an empty result. Extra columns are not read. Two start marks precede each text. More than
2^32 numbers of words raise an error.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .minhash import TOGETHER, mix, word_hashes
from .store import cut, free, ship, slices

#: Bytes of text to a chunk; there are as many buckets for each length of n-gram as chunks.
CHUNK = 8 << 20
#: Rows that a chunk, or a task that adds up some chunks' rows, sends at most for each length of n-gram.
FAN = 256
#: Continuations of a context that meet in one bucket, about.
WIDE = 1 << 20
_U = np.uint64
_LOW, _PART = _U(0xFFFFFFFF), _U(0x9E3779B97F4A7C15)
_REQUEST = "bucket long, chunk long, packs array<binary>, sizes array<long>"
_ANSWER = "_chunk long, bucket long, packs array<binary>, sums array<long>"


class Plan(NamedTuple):
    """The ways by which n-grams reach their buckets."""

    buckets: int
    fan: int = FAN
    wide: int = WIDE

    @classmethod
    def even(cls, buckets: int, most: int = FAN, wide: int = WIDE) -> Plan:
        """The fewest levels of at most so many ways each, and no more ways than these levels need: with more of
        them a range, and the task that adds it up, would hold many chunks' entries."""
        depth = cls(buckets, most).depth
        fan = max(2, round(buckets ** (1 / depth)) - 1)
        while fan**depth < buckets:
            fan += 1
        return cls(buckets, fan, wide)

    @property
    def depth(self) -> int:
        d = 1
        while self.fan**d < self.buckets:
            d += 1
        return d

    def step(self, level: int) -> int:
        """Buckets to a route at this level, of which the last is ``depth``."""
        return self.fan ** (self.depth - level)

    def cuts(self, level: int, up: int = 0) -> np.ndarray:
        """The first bucket of each route at this level inside route ``up`` of the level above, and the end."""
        step = self.step(level)
        start = up * step * self.fan
        end = min(start + step * self.fan, self.buckets)
        return np.append(np.arange(start, end, step), end)

    def bucket(self, ctx: np.ndarray, part: np.ndarray | int = 0) -> np.ndarray:
        return mix(ctx + np.asarray(part, _U) * _PART) % _U(self.buckets)


def _pack(v: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte of equal weight; the first byte is their width."""
    if not len(v):
        return b""
    width = max(1, (int(v.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(np.ascontiguousarray(v, dtype="<u8").view(np.uint8).reshape(-1, 8).T[:width])
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    if size:
        planes = pa.decompress(raw[1:], decompressed_size=raw[0] * size, codec="zstd", asbytes=True)
        out[:, : raw[0]] = np.frombuffer(planes, np.uint8).reshape(raw[0], size).T
    return out.view("<u8").ravel()


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each chunk as one compressed Arrow stream for every ``CHUNK`` bytes that a task reads."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        chunk = t.column(0).to_numpy()
        order = np.argsort(chunk, kind="stable")
        u, first = np.unique(chunk[order], return_index=True)
        packed = []
        for x, y in zip(first, [*first[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t.take(pa.array(order[x:y])).combine_chunks())
            packed.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(packed, pa.binary())], ["_chunk", "packed"])

    held, size = [], 0
    for big in batches:
        for b in slices(big, "_text"):
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(2))).as_py() or 0
            if size >= 2 * CHUNK:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _rows(docs: pa.Table) -> pa.Table | None:
    """The rows of a chunk, in the order in which the streams are sorted by their bytes."""
    packed = sorted(docs.column("packed").to_pylist())
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packed]) if packed else None


def _release() -> None:
    """Give what the last group used back to the system; workers serve many groups."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _add(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, weights=x, minlength=size).astype(_U)


def _distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and the number of each value, by one unstable sort."""
    order = np.argsort(v)
    held = v[order]
    new = np.ones(len(v), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(new) - 1
    return held[new], order[new], at


def _in_buckets(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The stable order by bucket; short numbers are sorted by their digits."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


class _Words:
    """The distinct words of a chunk by bucket, and the place of every token's word."""

    def __init__(self, texts: list[str | None], plan: Plan):
        parts, at, size = [], 0, 0
        for k, t in enumerate(texts, 1):  # hashed in pieces, as hashing takes many times a text's bytes
            size += len(t or "")
            if size >= TOGETHER or k == len(texts):
                parts.append(word_hashes([x or "" for x in texts[at:k]]))
                at, size = k, 0
        tokens = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, _U)
        self.counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
        self.gram, self.at = _by_bucket(tokens, plan)


def _by_bucket(tokens: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words by bucket, and the place of each word given."""
    u, _, inverse = _distinct(tokens)
    order = _in_buckets(u % _U(plan.buckets), plan.buckets)
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    return u[order], rank[inverse]


class _Grams:
    """The distinct pairs of a context and a word by bucket, context and word. A context has a head in
    each bucket that holds a part of it; ``parts``, where given, are the parts of each pair's context."""

    def __init__(self, ctx: np.ndarray, word: np.ndarray, plan: Plan, parts: np.ndarray | None = None):
        u, _, at = _distinct(ctx)
        of, bucket = np.arange(len(u)), plan.bucket(u)
        self.split = parts is not None
        if self.split:
            many = np.ones(len(u), np.int64)
            many[at] = parts
            whole = many == 1
            in_part = ~whole[at]
            # contexts in parts are few, and only what belongs to them is dealt and looked up by part
            of = np.repeat(np.flatnonzero(~whole), many[~whole])
            part = np.arange(len(of)) - np.repeat(np.cumsum(many[~whole]) - many[~whole], many[~whole])
            dealt = np.unique((plan.bucket(u[of], part) << _U(32)) | of.astype(_U))
            heads = np.sort(np.concatenate([(bucket[whole] << _U(32)) | np.flatnonzero(whole).astype(_U), dealt]))
            of, bucket = (heads & _LOW).astype(np.int64), heads >> _U(32)
            mine = (plan.bucket(ctx[in_part], mix(word[in_part]) % parts[in_part]) << _U(32)) | at[in_part].astype(_U)
            place = np.empty(len(u), np.int64)
            place[of] = np.arange(len(of))
            at = place[at]
            at[in_part] = np.searchsorted(heads, mine)
            self.parted = ~whole[of]
        order = _in_buckets(bucket, plan.buckets)
        rank = np.empty(len(of), np.int64)
        rank[order] = np.arange(len(of))
        self.of, self.bucket = of[order], bucket[order].astype(np.int64)
        self.ctx = u[self.of]
        key = (rank[at].astype(_U) << _U(32)) | word
        g, self.first, self.at = _distinct(key)
        self.head, self.word = (g >> _U(32)).astype(np.int64), g & _LOW


def _grams(words: _Words, number: np.ndarray, n: np.ndarray, kinds: int, plan: Plan) -> list[_Grams]:
    """The bigrams and trigrams of a chunk whose words have these numbers and counts; 0 is the start mark."""
    w = number[words.at]
    place = np.arange(len(w)) - np.repeat(np.cumsum(words.counts) - words.counts, words.counts)
    before = lambda x, k, start: np.where(place < k, _U(start), np.concatenate([np.zeros(k, _U), x])[: len(x)])
    one, two = before(w, 1, 0), before(w, 2, 0)
    parts = [None, None]
    if kinds > plan.wide:  # a context has no more continuations than the vocabulary and each of its words has tokens
        most = np.minimum(n[words.at], _U(kinds))
        most = [before(most, 1, kinds), before(most, 2, kinds)]
        parts = [(x + _U(plan.wide - 1)) // _U(plan.wide) for x in (most[0], np.minimum(*most))]
        parts = [p if p.max(initial=0) > 1 else None for p in parts]
    return [_Grams(one, w, plan, parts[0]), _Grams((two << _U(32)) | one, w, plan, parts[1])]


def _own(head: np.ndarray, n: np.ndarray, t: np.ndarray, size: int) -> list[np.ndarray]:
    """Counts over all and target texts; by context, both totals and numbers of continuations."""
    return [n.astype(_U), t.astype(_U), *(_add(head, x, size) for x in (n, t, n > 0, t > 0))]


def _requests(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["bucket", "chunk", "packs", "sizes"])


def _mine(docs: pa.Table, other: pa.Table, counts: np.ndarray | int) -> np.ndarray:
    good = set(other.column("mark").to_pylist()) - {None}
    return np.repeat(np.array([x in good for x in docs.column("_d").to_pylist()], bool), counts)


def _word_rows(plan: Plan, level: int, up: int, sender: int, gram: np.ndarray, n: np.ndarray, t: np.ndarray) -> list[tuple]:
    """A request for each route; every one answers, as their sums are the corpus' sums."""
    cuts = plan.cuts(level, up)
    bounds = np.searchsorted((gram % _U(plan.buckets)).astype(np.int64), cuts)
    return [
        (int(b) // plan.step(level), sender, [gram[x:y].tobytes(), _pack(n[x:y]), _pack(t[x:y])], [y - x])
        for b, x, y in zip(cuts, bounds, bounds[1:], strict=False)
    ]


def _ask_words(docs: pa.Table, other: pa.Table, plan: Plan) -> pa.Table:
    _release()
    rows, docs = [], _rows(docs)
    if docs is not None:
        chunk = docs.column("_chunk")[0].as_py()
        o = _Words(docs.column("_text").to_pylist(), plan)
        n = np.bincount(o.at, minlength=len(o.gram))
        t = np.bincount(o.at[_mine(docs, other, o.counts)], minlength=len(o.gram))
        rows = _word_rows(plan, 1, 0, chunk, o.gram, n, t)
    return _requests(rows)


def _added_words(asked: pa.Table, plan: Plan) -> tuple:
    """The words of some requests by bucket, their counts, the place of each one asked for, and the requests' sizes."""
    packs, sizes = asked.column("packs").to_pylist(), [s[0] for s in asked.column("sizes").to_pylist()]
    gram, at = _by_bucket(np.frombuffer(b"".join(p[0] for p in packs), _U), plan)
    n, t = (_add(at, np.concatenate([_unpack(p[k], s) for p, s in zip(packs, sizes, strict=True)]), len(gram)) for k in (1, 2))
    return gram, n, t, at, sizes


def _pass_words(asked: pa.Table, plan: Plan, level: int) -> pa.Table:
    _release()
    gram, n, t, _, _ = _added_words(asked, plan)
    return _requests(_word_rows(plan, level + 1, asked.column("bucket")[0].as_py(), asked.column("via")[0].as_py(), gram, n, t))


def _answer_words(asked: pa.Table, other: pa.Table | None, plan: Plan, level: int) -> pa.Table:
    """For each request of one bucket, or of one route that has its own answers: the counts and numbers of its words."""
    _release()
    gram, n, t, at, sizes = _added_words(asked, plan)
    up = asked.column("bucket")[0].as_py()
    if other is None:
        rank = np.empty(len(gram), _U)
        rank[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(gram), dtype=_U)
        number = rank * _U(plan.buckets) + _U(up + 1)
        if number.max(initial=0) >> _U(32):
            raise ValueError("more than 2^32 numbers of words")
        sums = [len(gram), int(n.sum()), int(t.sum())]
    else:
        (n, t, number), sums = _told_words(gram, _told(other), plan, level + 1, up)
    ends = np.cumsum(sizes)
    parts = [[_pack(x[at[e - s : e]]) for x in (n, t, number)] for s, e in zip(sizes, ends, strict=True)]
    return _answers(asked, parts, sums)


def _answers(asked: pa.Table, parts: list[list[bytes]], sums: list[int]) -> pa.Table:
    cols = [asked.column("chunk"), asked.column("bucket"), pa.array(parts, pa.list_(pa.binary())), pa.array([sums] * len(parts), pa.list_(pa.int64()))]
    return pa.table(cols, names=["_chunk", "bucket", "packs", "sums"])


def _told(other: pa.Table) -> list[tuple]:
    rows = zip(*(other.column(c).to_pylist() for c in ("bucket", "packs", "sums")), strict=True)
    return [r for r in rows if r[0] is not None]


def _told_words(gram: np.ndarray, told: list[tuple], plan: Plan, level: int = 1, up: int = 0) -> tuple[list[np.ndarray], list[int]]:
    """Counts over all and target texts and number of each word; the corpus' distinct words and tokens."""
    held, sums = [np.zeros(len(gram), _U) for _ in range(3)], [0, 0, 0]
    cuts = plan.cuts(level, up)
    bounds = np.searchsorted((gram % _U(plan.buckets)).astype(np.int64), cuts)
    first = int(cuts[0]) // plan.step(level)
    for b, packs, more in told:
        if b < plan.buckets:
            x, y = bounds[b - first : b - first + 2]
            for h, p in zip(held, packs, strict=True):
                h[x:y] = _unpack(p, y - x)
            sums = [p + q for p, q in zip(sums, more, strict=True)]
    return held, sums


def _gram_rows(plan: Plan, level: int, k: int, up: int, sender: int, o, n: np.ndarray, t: np.ndarray) -> list[tuple]:
    """A request for each route that has any of the heads; ``k`` is the length of the contexts."""
    cuts = plan.cuts(level, up)
    heads = np.searchsorted(o.bucket, cuts)
    bounds = np.searchsorted(o.head, heads)
    runs, rows = np.bincount(o.head, minlength=len(o.ctx)), []
    for b, x, y, g, h in zip(cuts, heads, heads[1:], bounds, bounds[1:], strict=False):
        if x < y:
            packs = [np.diff(o.ctx[x:y], prepend=_U(0)), o.bucket[x:y] - b, runs[x:y], o.word[g:h], n[g:h], t[g:h]]
            rows.append((k * plan.buckets + int(b) // plan.step(level), sender, [_pack(v) for v in packs], [y - x, h - g]))
    return rows


def _ask_grams(docs: pa.Table, other: pa.Table, plan: Plan) -> pa.Table:
    _release()
    rows, docs = [], _rows(docs)
    if docs is not None:
        chunk = docs.column("_chunk")[0].as_py()
        words = _Words(docs.column("_text").to_pylist(), plan)
        mine = _mine(docs, other, words.counts)
        (total, _, number), (kinds, *_) = _told_words(words.gram, _told(other), plan)
        for k, o in enumerate(_grams(words, number, total, kinds, plan), 1):
            n = np.bincount(o.at, minlength=len(o.word))
            t = np.bincount(o.at[mine], minlength=len(o.word))
            rows += _gram_rows(plan, 1, k, 0, chunk, o, n, t)
    return _requests(rows)


class _Added:
    """The n-grams of some requests for one route, by bucket, context and word, and the places of those asked for."""

    def __init__(self, asked: pa.Table, plan: Plan, level: int):
        packs, self.sizes = asked.column("packs").to_pylist(), np.array(asked.column("sizes").to_pylist(), np.int64)
        got = lambda k: np.concatenate([_unpack(p[k], s[int(k > 2)]) for p, s in zip(packs, self.sizes, strict=True)])
        self.order, self.up = divmod(asked.column("bucket")[0].as_py(), plan.buckets)
        ctx = np.concatenate([np.cumsum(_unpack(p[0], s[0]), dtype=_U) for p, s in zip(packs, self.sizes, strict=True)])
        u, _, self.at = _distinct(ctx)
        heads = np.arange(len(u), dtype=_U)
        if level < plan.depth:  # a context may have several buckets in a route, of which each has its head
            heads, _, self.at = _distinct((got(1) << _U(32)) | self.at.astype(_U))
        self.ctx, self.bucket = u[(heads & _LOW).astype(np.int64)], (heads >> _U(32)).astype(np.int64) + self.up * plan.step(level)
        self.place = np.repeat(np.arange(len(ctx)), got(2).astype(np.int64))
        g, _, self.inverse = _distinct((self.at[self.place].astype(_U) << _U(32)) | got(3))
        self.head, self.word = (g >> _U(32)).astype(np.int64), g & _LOW
        self.own_n, self.own_t = got(4), got(5)
        self.n, self.t = _add(self.inverse, self.own_n, len(g)), _add(self.inverse, self.own_t, len(g))


def _pass_grams(asked: pa.Table, plan: Plan, level: int) -> pa.Table:
    _release()
    o = _Added(asked, plan, level)
    return _requests(_gram_rows(plan, level + 1, o.order, o.up, asked.column("via")[0].as_py(), o, o.n, o.t))


def _answer_grams(asked: pa.Table, other: pa.Table | None, plan: Plan, level: int) -> pa.Table:
    """For each request of one bucket, or of one route that has its own answers: by how much the corpus' counts of
    its n-grams and of their contexts exceed the request's own, which are small numbers and mostly 0."""
    _release()
    o = _Added(asked, plan, level)
    whole = _own(o.head, o.n, o.t, len(o.ctx))
    if other is not None:
        _tell_grams(whole, o.order, o, _told(other), plan, level + 1, o.up)
    own = _own(o.place, o.own_n, o.own_t, len(o.at))
    rest = [w[o.inverse if k < 2 else o.at] - x for k, (w, x) in enumerate(zip(whole, own, strict=True))]
    parts = []
    for (c, g), (to_c, to_g) in zip(o.sizes, np.cumsum(o.sizes, axis=0), strict=True):
        parts.append([_pack(x[to_g - g : to_g] if k < 2 else x[to_c - c : to_c]) for k, x in enumerate(rest)])
    return _answers(asked, parts, [])


def _tell_grams(held: list[np.ndarray], k: int, o, told: list[tuple], plan: Plan, level: int = 1, up: int = 0) -> None:
    """Add what the routes answer to the counts held for n-grams and heads."""
    cuts = plan.cuts(level, up)
    heads = np.searchsorted(o.bucket, cuts)
    bounds = np.searchsorted(o.head, heads)
    first = int(cuts[0]) // plan.step(level)
    for b, packs, _ in told:
        if b // plan.buckets == k:
            i = b % plan.buckets - first
            for j, p in enumerate(packs):
                x, y = (bounds if j < 2 else heads)[i : i + 2]
                held[j][x:y] += _unpack(p, y - x)


def _exchange(asked: DataFrame, plan: Plan, pass_on: Callable, answer: Callable, level: int = 1) -> DataFrame:
    """The answers to requests, by as many levels as the plan has."""
    if level == plan.depth:
        return asked.groupBy("bucket").applyInArrow(lambda x: answer(x, None, plan, level), _ANSWER)
    asked = cut(asked.withColumn("via", F.expr(f"chunk div {plan.fan}")))
    ways = asked.groupBy("bucket", "via")
    passed = ways.applyInArrow(lambda x: pass_on(x, plan, level), _REQUEST)
    up = F.expr(f"bucket - bucket % {plan.buckets} + bucket % {plan.buckets} div {plan.fan}")
    told = _exchange(passed, plan, pass_on, answer, level + 1).select(up.alias("up"), F.col("_chunk").alias("via"), "bucket", "packs", "sums")
    done = cut(ways.cogroup(told.groupBy("up", "via")).applyInArrow(lambda x, y: answer(x, y, plan, level), _ANSWER))
    free(asked)
    return done


class _Pairs:
    """The distinct pairs of a text and an n-gram in it, by text and n-gram, with their counts."""

    def __init__(self, text: np.ndarray, at: np.ndarray, o: _Grams | None = None):
        key = (text.astype(_U) << _U(32)) | at.astype(_U)
        u, *rest = _distinct(key)
        del key
        self.first, self.at = (x.astype(np.int32) for x in rest)
        self.n = np.bincount(self.at, minlength=len(u)).astype(np.int32)
        self.text, self.gram = (u >> _U(32)).astype(np.int32), (u & _U(0xFFFFFFFF)).astype(np.int32)
        if o is not None:
            self.ctx = o.head[self.gram].astype(np.int32)
            # n-grams are numbered by context, so those of one text and a context in one part are neighbours
            new = (np.diff(self.text, prepend=-1) != 0) | (np.diff(self.ctx, prepend=-1) != 0)
            self.run = np.cumsum(new, dtype=np.int32) - np.int32(1)
            if o.split:
                some = np.flatnonzero(o.parted[self.ctx])
                key = (self.text[some].astype(_U) << _U(32)) | o.of[self.ctx[some]].astype(_U)
                self.run[some] = np.int32(len(new)) + _distinct(key)[2].astype(np.int32)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.run, weights=x)[self.run]


def _losses(words: _Words, target: np.ndarray, other: pa.Table, plan: Plan) -> list[np.ndarray]:
    """Bits of loss of every token of a chunk under the target and the background model, both without
    the counts of the token's own text; ``target`` tells which texts are in the target."""
    mine = np.repeat(target, words.counts)
    told = _told(other)
    (n, t, number), (kinds, total, own) = _told_words(words.gram, told, plan)
    orders = _grams(words, number, n, kinds, plan)
    held = []
    for k, o in enumerate(orders, 1):
        counts = (np.bincount(x, minlength=len(o.word)) for x in (o.at, o.at[mine]))
        held.append(_own(o.head, *counts, len(o.ctx)))
        _tell_grams(held[-1], k, o, told, plan)
        if o.split:
            held[-1][2:] = [_add(o.of, x, len(o.of))[o.of] for x in held[-1][2:]]
    del told
    text = np.repeat(np.arange(len(words.counts), dtype=np.int32), words.counts)
    models = ((1, target), (0, np.ones(len(target), bool)))
    pairs, probs = _Pairs(text, words.at), []
    for m, inside in models:
        left = pairs.n * inside[pairs.text]
        whole = (own if m else total) - (words.counts * inside)[pairs.text]
        probs.append(((t if m else n)[pairs.gram] - left + 1.0) / (whole + kinds + 1))
    del n, t, number, mine, left, whole
    while orders:  # one length at a time, as each holds a dozen arrays of the chunk's size
        o, h = orders.pop(0), held.pop(0)
        below, pairs = pairs.at, _Pairs(text, o.at, o)
        below = below[pairs.first]
        for k, (m, inside) in enumerate(models):
            left = pairs.n * inside[pairs.text]
            rest = h[m][pairs.gram].astype(float) - left
            after = h[4 + m][pairs.ctx] - pairs.by_context((left > 0) & (rest == 0))
            whole = h[2 + m][pairs.ctx] - pairs.by_context(left)
            lower = probs[k][below]
            probs[k] = np.where(whole > 0, (rest + after * lower) / np.maximum(whole + after, 1), lower)
    return [-np.log2(p)[pairs.at] for p in probs]


def score(docs: DataFrame, targets: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK, fan: int = FAN, wide: int = WIDE) -> DataFrame:
    """The columns ``keep`` with n_tokens, ce_target, ce_background and ce_diff (bits a word);
    the target are the documents whose id is in ``targets`` (column doc_id)."""
    ship(docs.sparkSession)
    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    plan = Plan.even(max(1, -(-held // chunk_bytes)), fan, wide)
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(plan.buckets)).cast("long")
    # ids without a value are no target and are dealt by their text
    chunk = F.when(F.col(doc_id).isNull(), deal(F.col(text))).otherwise(deal(F.col(doc_id)))
    # one projection for all three passes, so that the texts are shuffled once
    src = docs.select(chunk.alias("_chunk"), F.col(doc_id).alias("_d"), F.col(text).alias("_text"), *keep)
    src = src.mapInArrow(_deal, "_chunk long, packed binary").groupBy("_chunk")
    fields = {f.name: f for f in docs.schema}
    marks = targets.select(F.col("doc_id").cast(fields[doc_id].dataType).alias("mark")).filter("mark IS NOT NULL").distinct()
    marks = marks.select(deal(F.col("mark")).alias("_chunk"), "mark")
    scores = ("n_tokens", "ce_target", "ce_background", "ce_diff")
    schema = T.StructType([*(fields[c] for c in keep), T.StructField(scores[0], T.LongType(), False), *(T.StructField(c, T.DoubleType()) for c in scores[1:])])

    def tell(own: pa.Table, other: pa.Table) -> pa.Table:
        _release()
        own = _rows(own)
        if own is None:
            return pa.table({f.name: [] for f in schema})
        words = _Words(own.column("_text").to_pylist(), plan)
        counts = words.counts
        has = counts > 0
        first = (np.cumsum(counts) - counts)[has]
        cols = []
        for loss in _losses(words, _mine(own, other, 1), other, plan):
            total = np.full(len(counts), np.nan)
            if len(first):
                total[has] = np.add.reduceat(loss, first) / counts[has]
            cols.append(total)
        cols.append(cols[0] - cols[1])
        got = [pa.array(counts.astype(np.int64)), *(pa.array(c, pa.float64(), from_pandas=True) for c in cols)]
        return pa.table([*(own.column(c) for c in keep), *got], names=[*keep, *scores])

    def pass_(run, to, *others: DataFrame) -> DataFrame:
        other = others[0]
        for o in others[1:]:
            other = other.unionByName(o, allowMissingColumns=True)
        return src.cogroup(other.groupBy("_chunk")).applyInArrow(run, to)

    asked = pass_(lambda own, x: _ask_words(own, x, plan), _REQUEST, marks)
    words = _exchange(asked, plan, _pass_words, _answer_words)
    asked = pass_(lambda own, x: _ask_grams(own, x, plan), _REQUEST, words, marks)
    grams = _exchange(asked, plan, _pass_grams, _answer_grams)
    return pass_(tell, schema, words, grams, marks)
