"""Centroid clustering against plain integers."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import centroids as C, queries

SF = "/root/testdata/sf0.001"


def plain(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-C.LIMIT, min(C.LIMIT, x)) for x in q]) for i, q in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(q) for _, q in start[:k]]

    def assign():
        out = []
        for _, q in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), c) for c, m in enumerate(cents))
            out.append((c, d))
        return out

    for _ in range(rounds):
        to = assign()
        for c in range(len(cents)):
            own = [q for (_, q), (x, _) in zip(kept, to, strict=True) if x == c]
            if own:
                cents[c] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    to = assign()
    total = sum(d for _, d in to)
    by = {c: sum(d for x, d in to if x == c) for c in range(len(cents))}
    return sorted(((i, c, d, by[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, to, strict=True)), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 64)]) for i in range(60)]
    rows += [(5, rows[5][1])] * 20 + [(200, [0.0] * 64), (201, [0.0] * 64), (None, [0.1] * 64), (202, [1e12] + [0.0] * 63)]
    bad = [(300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65), (304, [None] + [0.1] * 63), (305, [float("nan")] + [0.1] * 63), (306, [float("-inf")] + [0.1] * 63)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).withColumn("id", F.lit(2)).repartition(4)
    assert got(C.report(table)) == plain(rows)
    assert got(C.report(table.filter("vec_id in (1, 2, 3, 300)"))) == plain(rows[1:4])
    assert C.report(table.filter("vec_id = 300")).count() == 0


def test_screening_is_lossless_and_screens():
    rng = np.random.default_rng(2)
    centers = rng.integers(-40, 40, (16, 64))
    q = centers[rng.integers(0, 16, 500)] + rng.integers(-3, 4, (500, 64))
    to, d, measured = C.nearest(q, C.compressed(q), centers, C.compressed(centers))
    every = ((q[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (to == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert measured < 2 * len(q)
    far = rng.integers(-C.LIMIT, C.LIMIT, (50, 64))
    same = np.concatenate([far[:8], far[:8]])
    to, d, _ = C.nearest(far, C.compressed(far), same, C.compressed(same))
    every = ((far[:, None, :] - same[None]) ** 2).sum(axis=2)
    assert (to == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_query_equals_plain_integers(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(queries.op12_centroid_clustering(spark, SF)) == plain(rows)
