import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import queries, word_lm


def brute(texts, own):
    """Witten-Bell word trigram losses by dictionaries, each text under models of the others."""
    words = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    k = len({w for d in words for w in d}) + 1

    def model(some):
        n, after = Counter(), defaultdict(set)
        for d in some:
            d = [None, None, *d]
            for i in range(2, len(d)):
                for back in (0, 1, 2):
                    g = tuple(d[i - back : i + 1])
                    n[g] += 1
                    after[g[:-1]].add(g[-1])
        whole = Counter()
        for g, x in n.items():
            whole[g[:-1], len(g)] += x

        def p(g):
            if len(g) == 1:
                return (n[g] + 1) / (whole[(), 1] + k)
            total, kinds = whole[g[:-1], len(g)], len(after[g[:-1]])
            return (n[g] + kinds * p(g[1:])) / (total + kinds) if total else p(g[1:])

        return p

    out = []
    for i, d in enumerate(words):
        rest = [(x, o) for j, (x, o) in enumerate(zip(words, own)) if j != i]
        models = model([x for x, o in rest if o]), model([x for x, _ in rest])
        full = [None, None, *d]
        grams = [tuple(full[i - 2 : i + 1]) for i in range(2, len(full))]
        out.append((len(d), *(sum(-math.log2(p(g)) for g in grams) / len(grams) if grams else None for p in models)))
    return out


TEXTS = ["a b a b c", "a b, B a! a b b a", "", None, "é zz é a b c", "a b a b c", "q", "a b c d e f g a b c d", "..."]
OWN = [1, 0, 0, 1, 0, 1, 0, 0, 1]


@pytest.mark.parametrize("chunk_bytes,fan,wide", [(1 << 20, 256, 1 << 20), (12, 256, 1 << 20), (12, 256, 2), (12, 2, 1)])
def test_scores_against_brute_force(spark, chunk_bytes, fan, wide):
    """One chunk, many, contexts in parts, and both with several levels of two ways."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    marks = spark.createDataFrame([(i,) for i, o in enumerate(OWN) if o] * 2 + [(None,), (99,)], "doc_id long")
    got = {r.doc_id: r for r in word_lm.score(df, marks, chunk_bytes=chunk_bytes, fan=fan, wide=wide).collect()}
    assert len(got) == len(TEXTS)
    for i, (n, ct, cb) in enumerate(brute(TEXTS, OWN)):
        assert got[i].n_tokens == n
        if ct is None:
            assert got[i].ce_target is None and got[i].ce_diff is None
        else:
            assert got[i].ce_target == pytest.approx(ct) and got[i].ce_background == pytest.approx(cb)
            assert got[i].ce_diff == pytest.approx(ct - cb)


def test_empty_tables_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (None, "d")], "doc_id long, text string")
    none = df.limit(0)
    assert word_lm.score(none, none).count() == 0
    got = word_lm.score(df, none, chunk_bytes=2).collect()
    assert len(got) == 3 and all(r.ce_target == pytest.approx(math.log2(5)) for r in got)


def test_query_tells_word_order_apart(spark, tmp_path):
    """The same words with the same byte trigrams around each join differ only as word trigrams."""
    rows = [(1, "red ox red cat red ox red"), (2, "red ox red ox red cat red")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op4_lm_scoring(spark, str(tmp_path)).collect()}
    want = brute([t for _, t in rows], [1, 0])
    for i, (n, ct, cb) in enumerate(want, 1):
        assert (got[i].n_tokens, got[i].ce_diff) == (n, pytest.approx(ct - cb))


@pytest.mark.parametrize("buckets", [1, 2, 7, 256, 257, 3840, 70_000])
@pytest.mark.parametrize("fan", [2, 256])
def test_routes_are_few_and_cover_all_buckets(buckets, fan):
    plan = word_lm.Plan(buckets, fan)
    routes = [0]
    for level in range(1, plan.depth + 1):
        cuts = [plan.cuts(level, r) for r in routes]
        assert all(2 <= len(c) <= fan + 1 for c in cuts)
        routes = [int(b) // plan.step(level) for c in cuts for b in c[:-1]]
        assert routes == list(range(-(-buckets // plan.step(level))))
    assert routes == list(range(buckets))


def test_requests_grow_with_the_chunks(spark):
    """Ten times the chunks send about ten times the rows, not a hundred times."""
    sent = {}
    for chunks in (40, 400):
        plan = word_lm.Plan(chunks, fan=16)
        words = np.unique(word_lm.mix(np.arange(5000, dtype=np.uint64)))
        gram, at = word_lm._by_bucket(words, plan)
        o = word_lm._Grams(gram, at.astype(np.uint64), plan)
        ones = np.ones(len(gram), np.int64)
        rows = word_lm._word_rows(plan, 1, 0, 0, gram, ones, ones) + word_lm._gram_rows(plan, 1, 1, 0, 0, o, ones, ones)
        sent[chunks] = chunks * len(rows)
    assert sent[400] <= 2 * 400 * 16 and sent[400] <= 20 * sent[40]


def test_a_wide_context_is_dealt_in_parts():
    """A million continuations of one context lie in no bucket by more than a few times the bound."""
    plan = word_lm.Plan(64, wide=1 << 15)
    word = np.arange(1, 1_000_001, dtype=np.uint64)
    ctx = np.full(len(word), 7, np.uint64)
    o = word_lm._Grams(ctx, word, plan, np.full(len(word), 31, np.uint64))
    held = np.bincount(o.head)
    assert held.sum() == len(word) and held.max() <= 5 * plan.wide
    assert len(o.of) > 16 and set(o.of.tolist()) == {0}
    # a chunk with one of these bigrams asks all parts, so that it can add up their totals
    few = word_lm._Grams(ctx[:1], word[:1], plan, np.full(1, 31, np.uint64))
    assert few.bucket.tolist() == o.bucket.tolist()


@pytest.mark.parametrize("buckets", [2, 256, 257, 750, 3600, 65_536, 65_537, 1_000_000])
def test_a_task_of_each_level_adds_up_about_a_chunk(buckets):
    plan = word_lm.Plan.even(buckets)
    assert plan.fan <= word_lm.FAN and plan.depth == word_lm.Plan(buckets).depth
    for level in range(1, plan.depth):
        # so many chunks meet in a task, and each sends it the share of the buckets that its range covers
        assert plan.fan**level * plan.step(level) / buckets < 2.2


def test_scores_take_even_ways(spark, monkeypatch):
    """Of 300 chunks of a few words each no task may get the rows of many."""
    met = []
    real = word_lm._exchange
    monkeypatch.setattr(word_lm, "_exchange", lambda asked, plan, *more: met.append(plan) or real(asked, plan, *more))
    word_lm.score(spark.createDataFrame([(i, "a b c d") for i in range(300)], "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long"), chunk_bytes=7)
    assert met[0].buckets > word_lm.FAN and met[0].fan**2 < 2 * met[0].buckets
