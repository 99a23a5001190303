from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bloom
from sparkloom.llm import line_dedup as L


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(" \t\n\v\f\r").translate(L._LOWER)
            if len(k) >= 20:
                held[k].add(i)
    keeper = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v - {None}) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(x.strip(" \t\n\v\f\r").translate(L._LOWER), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    a, b = "A common line of the corpus", "another line that is repeated"
    rows = [(1, f"{a}\nx\n{b}"), (2, f"  {a.upper()} \r\n{a}\nown text of document two"), (3, a), (4, b), (4, b), (None, f"{a}\n{b}"), (6, None), (7, ""), (8, f"{b}\n\n{b}"), (9, "short"), (10, "short"), (11, "short"), (12, "é" * 20), (13, "É" * 20), (14, "é" * 20), (15, "é" * 20), (16, (b + "\n") * 3000 + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).repartition(3)
    got = sorted(((r.doc_id, r.deduped, r.n_lines, r.n_dropped) for r in L.dedup_lines(df).collect()), key=str)
    assert got == brute(rows)
    assert L.dedup_lines(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit(7) for c in ("row", "gone", "gone_id", "_id", "_gone", "keeper", "a.b")})
    done = L.dedup_lines(clash)
    assert done.columns == [*clash.columns, *L.OUTPUTS]
    assert sorted(((r.doc_id, r.deduped, r.n_lines, r.n_dropped) for r in done.filter("gone = 7").collect()), key=str) == brute(rows)
    with pytest.raises(ValueError):
        L.dedup_lines(df.withColumn("N_LINES", F.lit(1)))


def test_shards_give_the_same_rows(spark):
    """Beyond the filters' bound: the same result, few once-only lines confirmed, a hot line split."""
    hot = "a line that every document of the table holds"
    rows = [(i, f"{hot}\nown line number {i} of this document\nshared line of the group number {i // 4}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    got = sorted(((r.doc_id, r.deduped, r.n_lines, r.n_dropped) for r in L.dedup_lines(df, max_bits=1 << 10, shard=256).collect()), key=str)
    assert got == want
    keys = L.line_keys(df).cache()
    n = keys.agg(F.sum("n_keys")).first()[0]
    assert n == 6000
    met = L._sharded(keys, n, 256).distinct()
    assert 4000 <= met.count() < 4000 + 0.1 * 2000
    assert met.select("key").distinct().count() < 501 + 0.1 * 2000


def test_filters_lose_nothing():
    rng = np.random.default_rng(2)
    bits = 1 << 19
    h = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    parts = [np.concatenate([h[:5000], h[:100]]), h[4000:12000], h[11000:]]
    tables = []
    for k, p in enumerate(parts):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        bloom.meet(once, twice, p, bits)
        tables += list(bloom.pieces(once, twice, k))
    import pyarrow as pa

    once, twice, _ = bloom._merge(None, [pa.Table.from_batches(tables)])
    seen = np.concatenate(parts)
    u, n = np.unique(seen, return_counts=True)
    assert bloom.contains(once, u, bits).all() and bloom.contains(twice, u[n > 1], bits).all()
    assert bloom.contains(twice, u[n == 1], bits).mean() < 0.2


def test_rows_without_an_id_do_not_gather(spark):
    a = "A common line of the corpus"
    rows = [(i, f"{a}\nown {i}") for i in range(3)] + [(None, f"{a}\nnull row {i} has its own line here\n{a}") for i in range(2000)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = L.repeated_keys(df)
    assert gone.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 1
    assert sorted(((r.doc_id, r.deduped, r.n_lines, r.n_dropped) for r in L.dedup_lines(df).collect()), key=str) == brute(rows)
