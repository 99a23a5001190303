"""Near-duplicate classes by ProbMinHash, banding and verification.

Shingles are the windows of five words of the lower-cased text (words are runs of
letters, digits and non-ASCII characters); a text of one to four words is one shingle.
A shingle's weight is 1 + ln(its count). The similarity of two texts is the larger of
their exact probability Jaccard over these weights and their plain Jaccard over the
distinct shingles; texts at ``THRESHOLD`` or more are linked, and a class is a
connected component of the links, named by its least doc_id.

Steps: texts with equal words are one vertex, known by a 64-bit hash of its word sequence.
Each vertex gets ``BANDS`` x ``ROWS`` registers: its shingles arrive by Poisson processes with
their weights as rates, each arrival draws a register, a register keeps its first arrival, and
a shingle's process ends as soon as it is later than every register. A text with a repeated
shingle gets as many registers again, with every weight 1, so that plain Jaccard links are
proposed too (without repeats both sets are the same). Vertices that share a
band meet in a bucket. Buckets are never expanded into all pairs: each member is
verified against the bucket's least member, links are joined into components, and
only members outside the component that is largest in their bucket are then verified
against the bucket's other components, all of them and exactly, so no link found by banding
is lost. They are verified inside blocks that carry their shingles; pairs whose components the
block has linked already are passed over, and only links that join components come out.

Shared-band probability at a similarity of 0.8: 1 - (1 - 0.8^7)^40 = 0.9999.

Edge cases: a row is judged by its own text, so rows of one doc_id with different texts may
have different classes; repeated rows come out repeated, with one class. A row with a null
text or doc_id is in no class with others (its class is its doc_id); texts without words but
not null are equal to each other. Ties are broken by the least doc_id. A very long text is
hashed whole by one task, which takes about 60 bytes of memory a word. An empty table gives an
empty result. Extra columns are not read, and ``keep_one`` passes them through under any name.
doc_id is a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .store import column, cut, free, released, ship, slices, unused

ROWS, BANDS = 7, 40
REGISTERS = ROWS * BANDS
SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of shingles of a bucket to a block; blocks, not rows, are paired.
BLOCK = 4 << 20
#: Bytes of text that are hashed together.
TOGETHER = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_INV = pow(_P, -1, 1 << 64)

_WORD_BYTE = np.zeros(256, bool)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)):
    _WORD_BYTE[_c] = True


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _U(_P)
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
        return x ^ (x >> _U(31))


_VALUE = mix(np.arange(256, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            one = np.full(size, _U(_P))
            one[0] = 1
            inv = np.full(size, _U(_INV))
            inv[0] = 1
            _POWERS[size] = np.multiply.accumulate(one), np.multiply.accumulate(inv)
    return _POWERS[size]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts in order, and the number of words of each text."""
    raw = [t.lower().encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    is_word = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(is_word.astype(np.int8), prepend=0, append=0))
    starts, stops = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * power[: len(data)], dtype=np.uint64)])
        h = mix((sums[stops] - sums[starts]) * inverse[starts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return h, counts


def shingles(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle window and the text that it is of."""
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(h)
    with np.errstate(over="ignore"):
        if n >= SHINGLE:
            win = np.zeros(n - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                win = mix(win + h[k : n - SHINGLE + 1 + k])
            whole = doc[: n - SHINGLE + 1] == doc[SHINGLE - 1 :]
            win, owner = win[whole], doc[: n - SHINGLE + 1][whole]
        else:
            win, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        small = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(small):
            own = np.zeros(len(small), np.uint64)
            for k in range(SHINGLE - 1):
                has = counts[small] > k
                own[has] = mix(own[has] + h[first[small[has]] + k])
            win, owner = np.concatenate([win, own]), np.concatenate([owner, small])
    return win, owner


def weighted(win: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash, count; sorted by text and hash."""
    order = np.lexsort((win, owner))
    w, o = win[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], w[at], np.diff(at, append=len(w))


def sketch(owner: np.ndarray, h: np.ndarray, count: np.ndarray, n_texts: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers, one row for each text; a text without shingles keeps zeros."""
    first = np.full(n_texts * m, np.inf)
    held = np.zeros(n_texts * m, np.uint64)
    live = np.arange(len(h))
    rate = 1.0 / (1.0 + np.log(count))
    time = np.zeros(len(h))
    state = mix(h ^ _U(0x5851F42D4C957F2D))
    while len(live):
        with np.errstate(over="ignore"):
            state[live] = s = mix(state[live])
            draw = mix(s ^ _U(0xD1342543DE82EF95))
        time[live] += -np.log1p(-(s >> _U(11)).astype(np.float64) * 2.0**-53) * rate[live]
        slot = owner[live] * m + ((draw >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        t = time[live]
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        held[slot[won]] = h[live[won]]
        last = first.reshape(n_texts, m).max(axis=1)
        live = live[t < last[owner[live]]]
    return held.reshape(n_texts, m)


def bands(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number enters the key."""
    grouped = registers.reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grouped.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key + grouped[:, :, k])
    return key


def similarity(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """The larger of probability Jaccard (weights 1 + ln count) and plain Jaccard; hashes sorted."""
    if not len(a) or not len(b):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    plain = len(ia) / (len(a) + len(b) - len(ia))
    wa, wb = 1 + np.log(ca), 1 + np.log(cb)
    x, y = wa[ia], wb[ib]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    above = np.cumsum(x[::-1])[::-1] + (wa.sum() - x.sum())  # shingles of a alone have an infinite ratio
    below = np.concatenate([[0.0], np.cumsum(y)[:-1]]) + (wb.sum() - y.sum())
    lead = np.searchsorted(ratio, ratio, side="left")  # equal ratios all count as above
    weighted_ = float((1.0 / (above[lead] / x + below[lead] / y)).sum())
    return max(plain, weighted_)


def identities(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the word sequence of each text."""
    first = np.concatenate([[0], np.cumsum(counts)])
    position = np.arange(len(h)) - np.repeat(first[:-1], counts)
    out = mix(counts.astype(np.uint64))
    with np.errstate(over="ignore"):
        for salt in (1, 1 << 40):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + mix(position.astype(np.uint64) + _U(salt))), dtype=np.uint64)])
            out = mix(out ^ (sums[first[1:]] - sums[first[:-1]]))
    return out.view(np.int64)


_SKETCH = "doc_id long, mark long, id long, bands array<long>"


def _sketches(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, id, bands) of rows (doc_id, mark, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", max_rows=500, max_bytes=TOGETHER):
                texts = b.column(2).to_pylist()
                h, counts = word_hashes(texts)
                o, w, c = weighted(*shingles(h, counts))
                held = sketch(o, w, c, len(texts))
                keys = list(bands(held).view(np.int64))
                more = np.unique(o[c > 1])  # without repeats the plain registers are the same
                if len(more):
                    mine = np.isin(o, more)
                    plain = sketch(np.searchsorted(more, o[mine]), w[mine], np.ones(mine.sum(), np.int64), len(more))
                    for k, extra in zip(more, bands(plain).view(np.int64), strict=True):
                        keys[k] = np.concatenate([keys[k], extra])
                lists = [k if n else [] for k, n in zip(keys, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(identities(h, counts)), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "mark", "id", "bands"])

    return docs.select("doc_id", "mark", "text").mapInArrow(released(run), _SKETCH)


def _sets(ids: DataFrame, vertices: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (id, packed) with the distinct shingles and counts of at least the vertices ``ids``.
    The texts of their representatives are re-read; a Bloom filter (bounded, see ``bloom``) keeps
    others out of the shuffle."""
    spark = docs.sparkSession
    named = lambda d, who: F.xxhash64(d[who], d["mark"])
    wanted = cut(vertices.join(ids, "id", "left_semi").select(named(vertices, "rep").alias("h")))
    bitmap, bits = bloom.of_column(wanted, "h", wanted.count())
    free(wanted)
    shared = spark.sparkContext.broadcast(bitmap)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = bloom.contains(shared.value, b.column(0).to_numpy().view(np.uint64), bits)
            if hit.any():
                for s in slices(b.filter(pa.array(hit)), "text", max_rows=500, max_bytes=TOGETHER):
                    texts = s.column(1).to_pylist()
                    h, counts = word_hashes(texts)
                    o, w, c = weighted(*shingles(h, counts))
                    cuts = np.searchsorted(o, np.arange(len(texts) + 1))
                    sets = [np.concatenate([w[x:y].view(np.int64), c[x:y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(identities(h, counts)), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "packed"])

    sets = docs.select(F.xxhash64(named(docs, "doc_id")).alias("h"), "text").mapInArrow(released(maybe), "id long, packed binary")
    return cut(sets.groupBy("id").agg(F.max("packed").alias("packed")))  # equal words have equal sets


def _unpacked(raw) -> tuple[np.ndarray, np.ndarray]:
    u = np.frombuffer(raw, np.int64)
    return u[: len(u) // 2].view(np.uint64), u[len(u) // 2 :]


def _verify(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) at the threshold or more, written."""
    ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    sets = _sets(ids, vertices, docs)
    left = sets.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    right = sets.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                ok.append(similarity(*_unpacked(x.as_buffer()), *_unpacked(y.as_buffer())) >= threshold)
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = cut(both.mapInArrow(released(test), "a long, b long"))
    free(sets)
    return links


def _members(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, id) with the component of each id."""
    return rows.join(roots.withColumnRenamed("root", "r"), "id", "left").select("key", "id", F.coalesce("r", "id").alias("root"))


def _across(rest: DataFrame, single: DataFrame, vertices: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b), written, that join different components which share a bucket of ``rest`` (key, id, root):
    every pair of a member outside the bucket's main component and one of another component is
    verified, in its first shared band, unless links of the same block join them already."""
    sizes = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    ids = cut(rest.select("id").distinct())
    marks = single.select("id", "bands").join(ids, "id", "left_semi").groupBy("id").agg(F.max("bands").alias("bands"))
    sets = _sets(ids, vertices, docs)
    known = cut(marks.join(sets, "id"))
    free(ids, sets)
    weight = rest.join(known.select("id", F.length("packed").alias("size")), "id").groupBy("key").agg(F.sum("size").alias("size"))
    full = rest.join(known, "id").join(per.join(weight, "key"), "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)))
    listed = lambda d, to: d.groupBy("key", "salt").agg(F.max("main").alias("main"), F.collect_list(F.struct("id", "root", "bands", "packed")).alias(to)).drop("salt")
    few = listed(full.filter("root <> main"), "x").withColumnRenamed("main", "m")
    both = few.join(listed(full, "y").drop("main"), "key").select("key", "m", "x", "y")

    def side(rows):
        flat = rows.flatten()
        ids, roots = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        # a text without repeats has the same keys for both sets of registers
        keys = np.stack([np.resize(np.asarray(v, np.int64), 2 * BANDS) for v in flat.field(2).to_pylist()]).reshape(len(ids), 2, BANDS)
        return ids, roots, keys, flat.field(3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(big.num_rows):
                b = big.slice(k, 1)
                key, main = b.column(0)[0].as_py(), b.column(1)[0].as_py()
                xi, xr, xk, xs = side(b.column(2))
                yi, yr, yk, ys = side(b.column(3))
                at = int(np.argwhere(xk[0] == key)[0][1])  # the bucket's band
                up: dict[int, int] = {}

                def find(v: int, up=up) -> int:
                    while up.get(v, v) != v:
                        up[v] = v = up.get(up[v], up[v])
                    return v

                left, right = [], []
                for i in range(len(xi)):
                    hit = (yr != xr[i]) & ((yr == main) | (yi > xi[i]))
                    j = np.flatnonzero(hit)
                    for p in (0, 1):  # an earlier shared band has the pair
                        for q in (0, 1):
                            j = j[~(yk[j, p, :at] == xk[i, q, :at]).any(axis=1)]
                    if not len(j):
                        continue
                    mine = _unpacked(xs[i].as_buffer())
                    for n in j.tolist():
                        u, v = find(int(xr[i])), find(int(yr[n]))
                        if u != v and similarity(*mine, *_unpacked(ys[n].as_buffer())) >= threshold:
                            up[max(u, v)] = min(u, v)
                            left.append(min(yi[n], xi[i]))
                            right.append(max(yi[n], xi[i]))
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    links = cut(both.mapInArrow(released(run), "a long, b long"))
    free(known)
    return links


def _links(vertices: DataFrame, single: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between vertices, enough to join every class."""
    rows = single.select(F.explode(F.array_distinct("bands")).alias("key"), "id")
    buckets = cut(rows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most"))
    shared = cut(rows.join(buckets.select("key", "least"), "key").select("key", "id", "least"))
    free(buckets)
    star = cut(shared.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    if star.isEmpty():
        return star
    links = _verify(star, vertices, docs, threshold)
    free(star)
    held = cut(_members(shared.select("key", "id").distinct(), components(links)))
    free(shared)
    split = cut(held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"))
    rest = cut(held.join(split, "key", "left_semi"))
    free(held, split)
    return links if rest.isEmpty() else links.union(_across(rest, single, vertices, docs, threshold))


def _row_classes(docs: DataFrame, threshold: float) -> DataFrame:
    """Rows (doc_id, mark, class_id) of rows (doc_id, mark, text) without nulls."""
    sketched = cut(_sketches(docs))
    # equal words: one vertex; pre-aggregated, so a group of any size is one row a task (written,
    # so that the joins read plain shuffles on both sides and a hot group can be split)
    vertices = cut(sketched.groupBy("id").agg(F.min("doc_id").alias("rep"), F.min_by("mark", "doc_id").alias("mark")))
    one = vertices.select("id", F.col("rep").alias("doc_id"), "mark")
    single = cut(sketched.select("id", "doc_id", "mark", "bands").join(one, ["id", "doc_id", "mark"], "left_semi").select("id", "bands"))
    roots = components(_links(vertices, single, docs, threshold))
    free(single)
    inner = roots.join(vertices, "id").select("root", "rep").union(roots.select("root").distinct().join(vertices, F.col("root") == F.col("id")).select("root", "rep"))
    names = cut(inner.groupBy("root").agg(F.min("rep").alias("name")))
    named = roots.join(names, "root").select("id", "name").union(names.select(F.col("root").alias("id"), "name"))
    labels = cut(vertices.join(named, "id", "left").select("id", F.coalesce("name", "rep").alias("class_id")))
    free(names, vertices)
    return sketched.select("doc_id", "mark", "id").join(labels, "id").select("doc_id", "mark", "class_id")


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(column(doc_id).cast("long").alias("doc_id"), F.xxhash64(column(text)).alias("mark"), column(text).alias("text"))


def near_duplicate_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id): one for each row of ``docs``; class_id is the least doc_id of the class."""
    src = _source(docs, text, doc_id)
    whole = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    alone = src.filter(~whole).select("doc_id", F.col("doc_id").alias("class_id"))
    return _row_classes(src.filter(whole), threshold).select("doc_id", "class_id").union(alone)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose class is named by another document."""
    src = _source(docs, text, doc_id).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    gone = _row_classes(src, threshold).filter("class_id <> doc_id")
    i, m = unused(docs, "gone_id"), unused(docs, "gone_mark")
    gone = gone.select(F.col("doc_id").alias(i), F.col("mark").alias(m)).distinct()
    return docs.join(gone, (column(doc_id).cast("long") == F.col(i)) & (F.xxhash64(column(text)) == F.col(m)), "left_anti")
