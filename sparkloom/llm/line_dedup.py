"""Line deduplication with two Bloom filters and an exact confirmation.

Each text is hashed once: a table of every document's distinct line keys, as 128-bit digests, is
written and serves the steps that follow. The first pass over it fills a filter of the keys met
once and one of those met twice (``bloom``). Only lines in the second are shuffled for the exact
count of documents; the filters' errors are removed there. A third step joins the confirmed
digests with their documents and rewrites the texts.

One pair of filters, broadcast, serves up to ``bloom.MAX_BITS`` bits. Beyond that the keys are
dealt by ranges of their hash into shards of about ``SHARD`` keys; a shard's task fills a pair of
filters of its own, sized to its keys, and probes them. There keys travel as digests with their
document, so that filters grow with the lines and nothing is broadcast; a key that a run of documents
already holds twice goes to the confirmation at once, and only one of its rows to the shard,
so a hot line does not gather. Both ways give the same rows.

A line's key is the line stripped of space and U+0009..U+000D at both ends, with A-Z
lower-cased. A key of at least ``min_chars`` code points found in at least
``min_docs`` documents loses all its lines except in the largest doc_id holding it.

Edge cases: a null or empty text is one empty line, and a null text comes out as the
empty text. Rows of one doc_id count as one document and are rewritten alike. A row
with a null doc_id does not count towards the documents of a key and loses the lines
that others confirm. Ties cannot occur: doc_ids order all holders. An empty table
gives an empty result. Extra columns pass through under any name but those of the outputs, which
raise ValueError. A very long text is split by one task, which holds its lines at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .store import column, cut, free, released, ship, slices

MIN_CHARS = 20
MIN_DOCS = 3
OUTPUTS = ("deduped", "n_lines", "n_dropped")
WIDE = 16  # bytes of a key's digest
#: Keys to a pair of filters where one pair would be larger than its bound.
SHARD = 1 << 20

_EDGE = " \t\n\v\f\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ANY_UPPER = re.compile("[A-Z]")


def key_of(line: str) -> str:
    k = line.strip(_EDGE)
    return k.translate(_LOWER) if _ANY_UPPER.search(k) else k


def _hash(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    """Digests of the distinct keys of a text that are long enough."""
    return {_hash(k) for line in (text or "").split("\n") if len(line) >= min_chars and len(k := key_of(line)) >= min_chars}


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (doc_id, n_keys, keys) of rows (doc_id, text): the digests of a document's keys, end to end."""
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_keys", T.LongType(), False), T.StructField("keys", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                found = [_keys(t, min_chars) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([b"".join(f) for f in found], pa.binary())], ["doc_id", "n_keys", "keys"])

    return docs.select("doc_id", "text").mapInArrow(released(run), schema).filter("n_keys > 0")


def _digests(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The digests of a batch of ``line_keys`` as pairs of numbers, and the row that each is of."""
    at = b.schema.get_field_index("keys")
    raw = np.frombuffer(b"".join(b.column(at).to_pylist()), np.uint64).reshape(-1, 2)
    return raw, np.repeat(np.arange(b.num_rows), b.column(b.schema.get_field_index("n_keys")).to_numpy())


def _pairs(b: pa.RecordBatch, raw: np.ndarray, row: np.ndarray) -> list[pa.Array]:
    wide = pa.Array.from_buffers(pa.binary(WIDE), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())])
    return [b.column(b.schema.get_field_index("doc_id")).take(pa.array(row)), wide.cast(pa.binary())]


def _suspects(keys: DataFrame, bits: int) -> DataFrame:
    """Rows (doc_id, key) whose key is in the filter of those met twice, by one broadcast pair of filters."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            bloom.meet(once, twice, _digests(b)[0][:, 0], bits)
        yield from bloom.pieces(once, twice, TaskContext.get().partitionId())

    _, twice = bloom.merged(keys.mapInArrow(released(fill), bloom._SCHEMA), bits)
    shared = keys.sparkSession.sparkContext.broadcast(twice)  # bits / 8 bytes, MAX_BITS / 8 at most

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, row = _digests(b)
            hit = bloom.contains(shared.value, raw[:, 0], bits)
            yield pa.RecordBatch.from_arrays(_pairs(b, raw[hit], row[hit]), ["doc_id", "key"])

    return keys.mapInArrow(released(probe), _pair_schema(keys))


def _pair_schema(keys: DataFrame) -> T.StructType:
    return T.StructType([keys.schema["doc_id"], T.StructField("key", T.BinaryType(), False)])


def _sharded(keys: DataFrame, n: int, shard: int) -> DataFrame:
    """The same rows for any number of keys: filters by ranges of the hash."""
    shards = -(-n // shard)
    dealt = T.StructType([T.StructField("shard", T.LongType(), False), T.StructField("sure", T.BooleanType(), False), *_pair_schema(keys).fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, row = _digests(b)
            _, first, inverse, count = np.unique(raw[:, 0], return_index=True, return_inverse=True, return_counts=True)
            sure = count[inverse] > 1
            for mark, some in ((True, np.flatnonzero(sure)), (False, np.sort(first))):
                # the high bits choose the shard, the low ones the places in its filters
                which = ((raw[some, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.full(len(some), mark)), *_pairs(b, raw[some], row[some])], dealt.names)

    rows = keys.mapInArrow(released(deal), dealt)
    bits = bloom.bits_for(2 * shard, per_key=8)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filters = [], {}
        for b in batches:
            held.append(b)
            raw = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(-1, 2)[:, 0]
            for s in np.unique(which := b.column(0).to_numpy()):
                if s not in filters:
                    filters[s] = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                bloom.meet(*filters[s], raw[which == s], bits)
        for b in held:
            raw = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(-1, 2)[:, 0]
            which, hit = b.column(0).to_numpy(), np.zeros(b.num_rows, bool)
            for s in np.unique(which):
                hit[which == s] = bloom.contains(filters[s][1], raw[which == s], bits)
            yield pa.RecordBatch.from_arrays(list(b.filter(pa.array(hit)).columns[2:]), ["doc_id", "key"])

    probed = rows.filter("NOT sure").repartition(shards, "shard").mapInArrow(released(probe), _pair_schema(keys))
    return rows.filter("sure").select("doc_id", "key").unionByName(probed)


def _holder(doc_id: str, text: str) -> Column:
    """What holds a line: the document of an id; a row without one is known by its text, so that such rows
    do not gather."""
    own = F.when(column(doc_id).isNull(), F.xxhash64(column(text)))
    return F.struct(column(doc_id).alias("id"), own.alias("own"))


def repeated_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int | None = None, shard: int = SHARD) -> DataFrame:
    """Rows (doc_id, key) for every document, as ``_holder`` names it, that has to give up a key's lines."""
    keys = cut(line_keys(docs.select(_holder(doc_id, text).alias("doc_id"), column(text).alias("text")), min_chars))
    n = keys.agg(F.sum("n_keys")).first()[0] or 1
    bits = bloom.bits_for(n, per_key=8)
    wide = n * 8 > (max_bits or bloom.MAX_BITS)
    # one row for each document and key: repeated rows of a document count once
    held = cut((_sharded(keys, n, shard) if wide else _suspects(keys, bits)).distinct())
    free(keys)
    # written, so that the join reads plain shuffles on both sides and a hot line can be split
    confirmed = cut(held.groupBy("key").agg(F.count("doc_id.id").alias("n"), F.max("doc_id.id").alias("keeper")).filter(F.col("n") >= min_docs))
    return held.join(confirmed, "key").filter(~F.col("doc_id.id").eqNullSafe(F.col("keeper"))).select("doc_id", "key")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, **kw) -> DataFrame:
    """``docs`` with ``deduped`` (the remaining lines joined by newlines), ``n_lines`` and ``n_dropped``."""
    taken = {c.lower() for c in docs.columns} & set(OUTPUTS)
    if taken:
        raise ValueError(f"output columns already exist: {sorted(taken)}")
    gone = repeated_keys(docs, text, doc_id, min_chars, min_docs, **kw)
    gone = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list("key").alias("gone"))
    # the other columns travel as one struct, so that none clashes with a name of this function
    others = [c for c in docs.columns if c != text]
    rest = F.struct(*(column(c) for c in others)) if others else F.struct(F.lit(0).alias("none"))
    src = docs.select(rest.alias("row"), _holder(doc_id, text).alias("doc_id"), column(text).alias("text"))
    same = F.col("doc_id.id").eqNullSafe(F.col("gone_id.id")) & F.col("doc_id.own").eqNullSafe(F.col("gone_id.own"))
    joined = src.join(gone.hint("shuffle_hash"), same, "left").select("row", "text", "gone")
    added = [T.StructField("deduped", T.StringType(), False), T.StructField("n_lines", T.LongType(), False), T.StructField("n_dropped", T.LongType(), False)]
    schema = T.StructType([joined.schema["row"], joined.schema["text"], *added])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                out, lines, dropped = [], [], []
                for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    t = t or ""
                    n = t.count("\n") + 1
                    lines.append(n)
                    if not g:
                        out.append(t)
                        dropped.append(0)
                        continue
                    g = set(g)
                    rest = [x for x in t.split("\n") if len(x) < min_chars or len(k := key_of(x)) < min_chars or _hash(k) not in g]
                    out.append("\n".join(rest))
                    dropped.append(n - len(rest))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "text", *OUTPUTS])

    done = joined.mapInArrow(released(rewrite), schema)
    return done.select(*((F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns), *OUTPUTS)


def oracle() -> str:
    """The result of the registered query as DuckDB SQL."""
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(regexp_replace(ls[i], '^[ \\t-\\r]+', ''), '[ \\t-\\r]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM l LEFT JOIN c USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
