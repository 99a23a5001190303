"""Bloom filters over 64-bit hashes, built by partition and merged in pieces.

Two filters are built together: ``once`` holds every hash, ``twice`` those met at
least twice (and, as filters err, a few more). A merge is exact in one direction: a
hash that two parts hold once has all its bits in both, so it enters ``twice``.

The size in bits is fixed by the caller, up to ``MAX_BITS``; past that the share of
false positives rises and more rows take the exact path, but none is lost. So the
broadcast filter has a proven bound of ``MAX_BITS / 8`` bytes. Parts travel as
compressed pieces of ``PIECE`` bytes and are merged in two rounds by piece, so a task
holds a bounded number of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

MAX_BITS = 1 << 27
PIECE = 1 << 16
HASHES = 3
FANOUT = 256

_SCHEMA = "piece int, part int, once binary, twice binary"


def bits_for(n: int, per_key: int = 16) -> int:
    """A power of two of at least ``per_key`` bits for each of ``n`` keys, within the bound."""
    return min(MAX_BITS, max(PIECE * 8, 1 << int(max(1, n * per_key) - 1).bit_length()))


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bit numbers of each hash, one row for each hash function."""
    h = h.astype(np.uint64, copy=False)
    step = (h >> np.uint64(33)) | np.uint64(1)
    mask = np.uint64(bits - 1)
    with np.errstate(over="ignore"):
        return np.stack([(h + np.uint64(k) * step) & mask for k in range(HASHES)])


def contains(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    if not len(h):
        return np.zeros(0, bool)
    p = places(h, bits)
    return ((bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def insert(bitmap: np.ndarray, h: np.ndarray, bits: int) -> None:
    p = places(h, bits).ravel()
    np.bitwise_or.at(bitmap, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def meet(once: np.ndarray, twice: np.ndarray, h: np.ndarray, bits: int) -> None:
    """Enter hashes, of which each stands for one more occurrence."""
    if len(h):
        u, n = np.unique(h, return_counts=True)
        again = u[(n > 1) | contains(once, u, bits)]
        if len(again):
            insert(twice, again, bits)
        insert(once, u, bits)


def pieces(once: np.ndarray, twice: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(once), PIECE):
        a, b = once[k : k + PIECE], twice[k : k + PIECE]
        if a.any():
            yield pa.RecordBatch.from_pydict(
                {
                    "piece": pa.array([k // PIECE], pa.int32()),
                    "part": pa.array([part % FANOUT], pa.int32()),
                    "once": pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()),
                    "twice": pa.array([zlib.compress(b.tobytes(), 1)], pa.binary()),
                }
            )


def _merge(key, rows):
    once, twice = np.zeros(PIECE, np.uint8), np.zeros(PIECE, np.uint8)
    part = 0
    for t in rows:
        for o, w, p in zip(t.column("once").to_pylist(), t.column("twice").to_pylist(), t.column("part").to_pylist(), strict=True):
            o, w = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, w))
            twice |= w | (once & o)
            once |= o
            part = p
    return once, twice, part


def _merge_group(table: pa.Table) -> pa.Table:
    once, twice, part = _merge(None, [table])
    return pa.table(
        {
            "piece": pa.array([table.column("piece")[0].as_py()], pa.int32()),
            "part": pa.array([part], pa.int32()),
            "once": pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()),
            "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary()),
        }
    )


def merged(parts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two merged filters, on the driver: at most ``MAX_BITS / 8`` bytes each."""
    ship(parts.sparkSession)
    some = parts.groupBy("piece", "part").applyInArrow(_merge_group, _SCHEMA)
    all_ = some.groupBy("piece").applyInArrow(_merge_group, _SCHEMA)
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for r in all_.collect():  # bounded by MAX_BITS, and compressed
        at = r.piece * PIECE
        once[at : at + PIECE] = np.frombuffer(zlib.decompress(r.once), np.uint8)
        twice[at : at + PIECE] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return once, twice


def of_column(df: DataFrame, column: str, n: int) -> tuple[np.ndarray, int]:
    """A filter of the long column (nulls are left out), for ``n`` expected values."""
    bits = bits_for(n)
    ship(df.sparkSession)
    src = df.select(F.xxhash64(F.col(column)).alias("h")).filter(F.col(column).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once = np.zeros(bits // 8, np.uint8)
        for b in batches:
            insert(once, b.column(0).to_numpy().view(np.uint64), bits)
        yield from pieces(once, np.zeros_like(once), TaskContext.get().partitionId())

    return merged(src.mapInArrow(run, _SCHEMA), bits)[0], bits
