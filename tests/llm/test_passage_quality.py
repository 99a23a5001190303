"""Attention-based quality: gradients, scores against a plain pass, held-out accuracy, edges."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import passage_quality as P, queries

SF = "/root/testdata/sf0.01"


def _weights(seed=0):
    rng = np.random.default_rng(seed)
    w = {"W": rng.normal(0, 0.2, (P.FEATURES, P.HIDDEN)), "b": rng.normal(0, 0.1, P.HIDDEN), "c": rng.normal(0, 1, P.HIDDEN), "d": rng.normal(0, 1, 1), "w": rng.normal(0, 1, P.GATE)}
    return w | {k: rng.normal(0, 0.5, (P.HIDDEN, P.GATE)) for k in "VU"} | {k: rng.normal(0, 0.1, P.GATE) for k in "vu"}


def test_gradients_are_the_slopes_of_the_loss():
    w, rng = _weights(), np.random.default_rng(1)
    x, starts, y = rng.normal(0, 1, (9, P.FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    _, g = P.loss_and_gradients(w, x, starts, y)
    for k, v in w.items():
        at = tuple(int(rng.integers(0, n)) for n in v.shape)
        up, down = ({**w, k: v.copy()} for _ in range(2))
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        slope = (P.loss_and_gradients(up, x, starts, y)[0] - P.loss_and_gradients(down, x, starts, y)[0]) / 2e-6
        assert abs(slope - g[k][at]) < 1e-5 + 1e-4 * abs(slope), k


def _plain_score(w, text: bytes) -> float:
    m = max(1, -(-len(text) // P.PASSAGE))
    codes, gates = [], []
    for k in range(m):
        part = text[k * len(text) // m : (k + 1) * len(text) // m]
        f = np.zeros(P.FEATURES)
        for b in part:
            f[P.FINE[b]] += 1 / len(part)
        for a, b in zip(part, part[1:], strict=False):
            f[P.N_FINE + P.COARSE[a] * P.N_COARSE + P.COARSE[b]] += 1 / len(part)
        f = np.sqrt(f)
        grams = [part[i : i + P.SHINGLE] for i in range(len(part) - P.SHINGLE + 1)]
        f[-2:] = len(set(grams)) / len(grams) if grams else 1, len(part) / P.PASSAGE
        h = np.tanh(f @ w["W"] + w["b"])
        codes.append(h)
        gates.append((np.tanh(h @ w["V"] + w["v"]) / (1 + np.exp(-(h @ w["U"] + w["u"])))) @ w["w"])
    e = np.exp(np.array(gates) - max(gates))
    return 1 / (1 + np.exp(-(e @ np.array(codes) / e.sum() @ w["c"] + w["d"][0])))


def test_scores_equal_a_plain_pass(monkeypatch):
    w = _weights(3)
    texts = [b"", b"a", b"short.", b"The same The same " * 200, "é ü % $$ | 12\n".encode() * 90, bytes(range(256)) * 9]
    want = [_plain_score(w, t) for t in texts]
    assert np.allclose(P.score_texts(P.Model(w), texts), want, atol=1e-6)
    monkeypatch.setattr(P, "TOGETHER", 3)
    assert np.allclose(P.score_texts(P.Model(w), texts), want, atol=1e-6)


def test_held_out_accuracy(spark):
    rows = queries.op13_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    bad = [r["score"] for r in held if not r["quality"]]
    good = [r["score"] for r in held if r["quality"]]
    assert np.mean([a < b for a in bad for b in good]) > 0.98


def test_one_bad_passage_among_good_ones_is_attended_to(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = P.fit(docs, labels)
    good = docs.join(labels.filter("quality = 1"), "doc_id").filter("length(text) > 2000").first()["text"].encode()
    _, (a, b) = P.cut_up(np.array([1024]))[0], P.cut_up(np.array([1024]))[1]
    assert (a, b) == (512, 512)
    bad = (b"win$$$ now!!! " * 40)[:512]
    one, two = P.score_texts(model, [good, good + bad])
    assert one > 0.5 and two < one


def test_nulls_empties_copies_and_lone_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a b c"), (3, "a b c"), (4, "$ $ $")], "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("id", F.lit(2))
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    rows = P.predict(docs, P.fit(docs, labels)).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 3, 4]
    assert {r["score"] for r in P.predict(docs, P.fit(docs, labels.filter("quality = 1"))).collect()} == {1.0}
    assert {r["score"] for r in P.predict(docs, P.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert P.predict(docs.limit(0), P.fit(docs.limit(0), labels)).count() == 0
    assert sorted(y for y, _ in P.sample(docs, labels, per_label=1)) == [0, 1]


def test_a_large_group_of_copies_fills_one_place_of_the_sample(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2900, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    pieces = [tuple(p) for _, p in P.sample(docs, labels, per_label=1000)]
    assert pieces.count(("copy",)) == 2 and len(pieces) > 50
