"""Centroid clustering of vectors, exact in integers, with block-norm screening.

Every component x becomes the integer floor(scale * x). Of each segment of ``SEGMENT``
components only two numbers are kept beside the vector: its sum and the norm of what its
mean leaves. They form a compressed vector, and by Cauchy-Schwarz the squared distance of two
compressed vectors is never more than that of the vectors. A centroid whose compressed
distance exceeds an exact distance already known is screened out; only the others are
measured, in 64-bit integers. The compressed vectors are computed once and written.

A round sends from each task one sum and count for each centroid and component; Spark adds
these, and the driver sees k * (dim + 1) numbers, whatever the number of vectors.

Edge cases: a vector that is null, of another length, or has a null or non-finite component is
left out. Integers beyond +-2^24 count as +-2^24, so that distances fit a long; a sum of distances
beyond a long is given as the largest long. Repeated rows count and are returned each. Equal
distances go to the centroid of the smaller number. Start vectors are chosen by the hash of
their id, equal ids by their components; rows with a null id are clustered but start only after
all others. Fewer vectors than centroids make fewer centroids. An empty table gives an empty
result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import column, cut, ship

DIM = 64
SEGMENT = 8
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
LIMIT = 1 << 24
#: Vectors that are compared together.
TOGETHER = 4096
LARGEST = (1 << 63) - 1


def compressed(q: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Two numbers for each segment: the scaled sum, and the norm of the rest.

    ``|x - y|^2`` of a segment is ``(sum x - sum y)^2 / n`` plus the squared distance of the two
    rests, which is at least the squared difference of their norms."""
    parts = q.reshape(len(q), q.shape[1] // segment, segment).astype(np.float64)
    sums = parts.sum(axis=2)
    rest = np.sqrt(((parts - sums[:, :, None] / segment) ** 2).sum(axis=2))
    return np.concatenate([sums / np.sqrt(segment), rest], axis=1)


def nearest(q: np.ndarray, small: np.ndarray, centroids: np.ndarray, small_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each row's nearest centroid, and how many distances were measured."""
    n, k = len(q), len(centroids)
    own, theirs = (small**2).sum(axis=1)[:, None], (small_centroids**2).sum(axis=1)[None, :]
    bound = own + theirs - 2 * small @ small_centroids.T
    bound -= 1e-12 * (own + theirs) + 1e-6  # what rounding may have added
    first = bound.argmin(axis=1)
    best = ((q - centroids[first]) ** 2).sum(axis=1)
    rows, numbers = np.nonzero(bound <= best[:, None])
    exact = np.full((n, k), LARGEST)
    exact[np.arange(n), first] = best
    other = numbers != first[rows]
    rows, numbers = rows[other], numbers[other]
    exact[rows, numbers] = ((q[rows] - centroids[numbers]) ** 2).sum(axis=1)
    to = exact.argmin(axis=1)
    return to, exact[np.arange(n), to], n + len(rows)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def prepare(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, q, small): the usable vectors as integers, with their compressed form."""
    ship(vectors.sparkSession)
    src = vectors.select(column(id_col).alias("id"), column(vec_col).cast("array<double>").alias("x")).filter((F.size("x") == dim) & F.forall("x", _finite))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("q", T.ArrayType(T.IntegerType())), T.StructField("small", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(q), _lists(compressed(q))], ["id", "q", "small"])

    return src.mapInArrow(run, schema)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _matrices(b: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, integers, compressed) of slices of a batch."""
    for at in range(0, b.num_rows, TOGETHER):
        part = b.slice(at, TOGETHER)
        q = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
        small = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1)
        yield at, q, small


def _sums(prepared: DataFrame, centroids: np.ndarray) -> dict[int, dict[int, int]]:
    """By centroid the exact sums of its vectors' components, and at -1 their number."""
    small_centroids, (k, dim) = compressed(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for b in batches:
            for _, q, small in _matrices(b, dim):
                to, _, _ = nearest(q, small, centroids, small_centroids)
                for c in range(k):
                    own = q[to == c]
                    total[c, 0] += len(own)
                    total[c, 1:] += own.sum(axis=0)
        c, at = np.nonzero((total[:, :1] > 0) & np.ones(dim + 1, bool))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(total[c, at])], ["c", "at", "v"])

    out: dict[int, dict[int, int]] = {}
    for r in prepared.mapInArrow(run, "c int, at int, v long").groupBy("c", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["c"], {})[r["at"]] = r["v"]
    return out


@dataclass
class Clusters:
    #: (id, cluster, distance)
    assigned: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "1") -> Clusters:
    """Assign every vector to one of ``k`` centroids after ``rounds`` rounds; see the module for the rules."""
    prepared = cut(prepare(vectors, id_col, vec_col, dim, scale))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = prepared.orderBy(order.asc_nulls_last(), F.col("q")).select("q").limit(k).collect()
    centroids = np.array([r["q"] for r in start], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        for c, sums in _sums(prepared, centroids).items():
            centroids[c] = [sums[at] // sums[-1] for at in range(dim)]
    small_centroids = compressed(centroids)
    schema = T.StructType([prepared.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, q, small in _matrices(b, dim):
                to, distance, _ = nearest(q, small, centroids, small_centroids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, TOGETHER), pa.array(to.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return Clusters(cut(prepared.mapInArrow(run, schema)), centroids)


def digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(vectors: DataFrame, id_col: str = "vec_id", **kw) -> DataFrame:
    """Every vector's cluster and distance, with the inertia of its cluster and of all, and its centroid's digest."""
    found = cluster(vectors, id_col, **kw)
    spark = vectors.sparkSession
    by = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = min(LARGEST, sum(int(r["s"]) for r in by))
    sums = [(r["cluster"], min(LARGEST, int(r["s"])), whole, digest(found.centroids[r["cluster"]])) for r in by]
    facts = spark.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each centroid, k at most
    return found.assigned.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same in SQL, with every distance measured."""

    def assign(to: str, centroids: str) -> str:
        distance = "list_sum([(q[i] - m[i]) * (q[i] - m[i]) for i in range(1, 65)])"
        return f"{to} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': CAST({distance} AS BIGINT), 'c': c}}) AS best FROM kept, {centroids} GROUP BY r)"

    def update(to: str, assigned: str, before: str) -> str:
        return f"""{to}_parts AS (SELECT best.c AS c, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM {assigned}, range(1, 65) t(i) GROUP BY ALL),
{to} AS (SELECT c, coalesce(moved.m, {before}.m) AS m FROM {before} LEFT JOIN
    (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS m FROM {to}_parts GROUP BY c) moved USING (c))"""

    steps = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if isfinite(x)]) = 64)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS INTEGER) AS c, q AS m FROM kept QUALIFY c < 16)",
    ]
    for k in range(ROUNDS):
        steps += [assign(f"a{k}", f"c{k}"), update(f"c{k + 1}", f"a{k}", f"c{k}")]
    steps.append(assign("a", f"c{ROUNDS}"))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} ON best.c = c"""
