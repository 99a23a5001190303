import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid as L


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in L._init(3, rng).items()}
    x = rng.integers(1, 200, (4, 7)).astype(np.uint8)
    x[1, 5:] = 0
    y = np.array([0, 2, 1, 1])
    _, g = L.loss_and_gradients(w, x, y)
    for k in ("V", "c", "Wf", "Ub", "Uf", "bf", "qb", "qf", "E"):
        at = (int(x[0, 2]), 3) if k == "E" else tuple(0 if s == 1 else s // 2 for s in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        want = (L.loss_and_gradients(up, x, y)[0] - L.loss_and_gradients(down, x, y)[0]) / 2e-2
        assert abs(want - g[k][at]) < 2e-3 * max(1, abs(want)), k


def test_reader_equals_training_network():
    rng = np.random.default_rng(1)
    w = L._init(3, rng)
    x = rng.integers(1, 255, (5, L.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 2, 0, 1])
    p = L.Reader(L.Model(["a", "b", "c"], w)).positions(x)
    assert p.shape == (L.WINDOW, 5, 3) and np.allclose(p.sum(axis=2), 1, atol=1e-5)
    loss = -np.log(p[:, np.arange(5), y]).mean()
    assert abs(loss - L.loss_and_gradients(w, x, y)[0]) < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    flagged = docs.withColumn("held", L.held_out(F.col("doc_id")))
    model = L.fit(flagged.filter(~F.col("held")))
    got = L.predict(flagged, model, keep=("doc_id", "held", "lang", "n_chars")).filter("held").collect()
    right = [r.lang == r.lang_pred for r in got if r.n_chars >= 100]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "123 !!", "en"), (None, "the and of", "en"), (5, "der die und " * 9000, "de"), (5, "der die und " * 9000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    model = L.fit(df, per_lang=5)
    got = L.predict(df, model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id and r.doc_id < 4) == [(1, "und"), (2, "und"), (3, "und")]
    assert {r.lang_pred for r in got if r.doc_id == 5} == {"de"} and len(got) == 6
    assert {r.lang_pred for r in L.predict(df, L.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0


def test_sample_keeps_every_label(spark):
    rows = [(i, f"text {i} of {k}", f"l{k:03d}") for i in range(6) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {y for _, y in L.sample(df)} == {r[2] for r in rows}
    few = L.sample(df.filter("lang < 'l003'"), per_lang=100, max_texts=100)
    assert len({t for t, _ in few}) > 6 and len({y for _, y in few}) == 3
    with pytest.raises(ValueError):
        L.sample(df, max_texts=69)


def test_copies_do_not_lose_a_label(spark):
    many = spark.range(100_000).select(F.concat(F.lit("copied text "), F.col("id") % 20).alias("text"), F.lit("xx").alias("lang"))
    few = spark.range(2000).select(F.concat(F.lit("own text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    texts = {}
    for t, y in L.sample(many.union(few)):
        texts.setdefault(y, set()).add(t)
    assert len(texts["xx"]) >= 20 and len(texts["en"]) >= 400


@pytest.mark.parametrize("labels,per_lang", [(64, 1), (300, 1), (5_000, 2), (25_600, 400)])
def test_every_one_of_many_labels_is_kept(spark, labels, per_lang):
    docs = spark.range(3 * labels).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.col("id") % labels).alias("lang"))
    rows = L.sample(docs, per_lang=per_lang)
    assert len({y for _, y in rows}) == labels and len(rows) <= L.CUTS * L.MAX_TEXTS


def test_pooled_scores_equal_a_plain_pass():
    rng = np.random.default_rng(3)
    w = L._init(3, rng)
    texts = [b"short", "é".encode() * 50, bytes(rng.integers(1, 255, 300).astype(np.uint8))]
    got = L.Reader(L.Model(["a", "b", "c"], w)).pooled(texts)
    for raw, p in zip(texts, got, strict=True):
        want = np.zeros(3)
        for at in range(0, len(raw), L.WINDOW):
            ids = np.zeros(L.WINDOW, np.int64)
            ids[: len(raw[at : at + L.WINDOW])] = list(raw[at : at + L.WINDOW])
            states = []
            for d in "fb":
                order = range(L.WINDOW) if d == "f" else range(L.WINDOW - 1, -1, -1)
                h, out = np.zeros(L.HIDDEN), [None] * L.WINDOW
                for t in order:
                    x, a = w["E"][ids[t]] @ w[f"W{d}"] + w[f"b{d}"], h @ w[f"U{d}"]
                    z, r = (1 / (1 + np.exp(-(x[i : i + L.HIDDEN] + a[i : i + L.HIDDEN]))) for i in (0, L.HIDDEN))
                    n = np.tanh(x[2 * L.HIDDEN :] + r * (a[2 * L.HIDDEN :] + w[f"q{d}"]))
                    h = out[t] = n + z * (h - n)
                states.append(out)
            for t in range(min(L.WINDOW, len(raw) - at)):
                logit = np.concatenate([states[0][t], states[1][t]]) @ w["V"] + w["c"]
                want += np.exp(logit) / np.exp(logit).sum()
        assert np.allclose(p, want / len(raw), atol=1e-4)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "the and of", "en", "a", "b")], "doc_id long, text string, lang string, letter string, said string")
    got = L.predict(df, L.fit(df), keep=("doc_id", "letter", "said")).first()
    assert (got.letter, got.said, got.lang_pred) == ("a", "b", "en")
