"""The corpus pipeline against a brute-force version of all its stages."""

import re
from collections import Counter, defaultdict

import regex

from pyspark.sql import functions as F

import corpus_pipeline as P
from sparkloom.llm import bpe, decontaminate as D, line_dedup as L, quality as Q
from tests.llm.test_minhash import bag, brute, words
from tests.llm.test_native import base_counts

SPACE = " \t\n\v\f\r"


def line_fails(x, following):
    dense = regex.sub(f"[{SPACE}]+", "", x)
    sym = len(regex.findall(Q.LINE_SYMBOL_SET, dense))
    runs_on = following is not None and regex.search(Q.RUNS_ON, following)
    open_ = regex.search(Q.LONG_LINE, x) and not regex.search(Q.CLOSED, x) and not regex.search(Q.OTHER_ENDS, x) and not runs_on
    said = len(x) <= Q.BOILERPLATE_CHARS and regex.search(Q.BOILERPLATE, x.lower())
    return bool(100 * sym > Q.MAX_LINE_SYMBOLS * len(dense) or open_ or regex.search(Q.MENU, x) or (len(x) <= Q.NAV_CHARS and regex.search(Q.NAV_LINE, x.lower())) or said)


def quality(docs):
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        n, *_, rep = base_counts(t)
        fails = [line_fails(x, y) for x, y in zip(lines, [*lines[1:], None])]
        bad = [x for x, f in zip(lines, fails) if f]
        if n >= 10 and 100 * rep <= 20 * n and 100 * sum(map(len, bad)) <= Q.MAX_LOST * sum(map(len, lines)):
            out[i] = "\n".join(x for x, f in zip(lines, fails) if not f) if bad else t
    return out


def lines(docs):
    held = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(k := L.key_of(x)) >= 20:
                held[k].add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if keeper.get(L.key_of(x), i) == i) for i, t in docs.items()}


def near(docs):
    up = {i: i for i in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    grams = {i: set(bag(t)) for i, t in docs.items()}
    by = defaultdict(set)
    for i, g in grams.items():
        for x in g or {()}:
            by[x].add(i)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in sorted(pairs):
        if find(a) != find(b) and (words(docs[a]) == words(docs[b]) or (len(grams[a] & grams[b]) > 0.3 * len(grams[a] | grams[b]) and brute(docs[a], docs[b]) >= 0.8)):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: t for i, t in docs.items() if find(i) == i}


def leaks(docs, items):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    seeds = defaultdict(list)
    its = [tok(t) for t in items]
    for w in its:
        for k, m in enumerate(D.MASKS):
            for p in range(len(w) - len(m) + 1):
                seeds[k, tuple(w[p + j] for j, x in enumerate(m) if x == "1")].append((w, p))
    out = {}
    for i, t in docs.items():
        d, hit = tok(t), False
        for k, m in enumerate(D.MASKS):
            for p in range(len(d) - len(m) + 1):
                for w, q in seeds.get((k, tuple(d[p + j] for j, x in enumerate(m) if x == "1")), ()):
                    wide = min(D.MIN_WINDOW, len(w))
                    lo, hi = max(len(m) - wide, -q, -p), min(wide, len(w) - q, len(d) - p)
                    a, b = max(-D.REACH, -q, -p), min(len(m) + D.REACH, len(w) - q, len(d) - p)
                    hit |= len(w) >= 5 and b - a >= wide and sum(d[p + o] == w[q + o] for o in range(a, b)) >= D.MIN_SHARE * (b - a)
                    hit |= len(w) >= 5 and any(sum(d[p + o] == w[q + o] for o in range(s, s + wide)) >= D.MIN_SHARE * wide for s in range(lo, hi - wide + 1))
        if not hit:
            out[i] = t
    return out


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = leaks(near(lines(quality(docs))), items)
    enc = bpe.encoding(bpe.rank_path(), bpe.split_pattern())
    got = {r.doc_id: r for r in P.run(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(list(r.token_ids) == enc.encode_ordinary(want[i]) and r.round_trip and r.n_tokens == len(r.token_ids) for i, r in got.items())


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, an empty table and clashing names, stage by stage."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    body = " ".join(f"word{i} and other{i * 7} things." for i in range(30))
    long = " ".join(f"Sentence s{i} says t{i * 3} of p{i}." for i in range(20_000))
    rows = [(1, None), (2, ""), (3, body), (3, body), (4, body + " More."), (None, "a b c " * 9), (5, long), (6, leak)]
    names = ["row", "kept", "cleaned", "deduped", "n_dropped", "gone", "bad", "gone_id", "gone_mark", "token_ids", "class_id", "a.b"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema).select("*", *(F.lit(7).alias(n) for n in names))
    want = {"quality_rules": {3: 2, 4: 1, 5: 1, 6: 1}, "line_dedup": {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, None: 1}, "near_dedup": {1: 1, 2: 1, 3: 2, 5: 1, 6: 1, None: 1}, "decontamination": {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, None: 1}}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        got = Counter(r.doc_id for r in out.filter("kept = 7").collect())
        assert got == want[name] or (name == "quality_rules" and got == {k: v for k, v in want[name].items() if k != 6}), (name, got)
        assert stage(spark, df.limit(0), sf).count() == 0, name
    done = {r.doc_id: r for r in P.STAGES[-1][1](spark, df, sf).collect()}
    assert done[1].n_tokens == done[2].n_tokens == 0 and all(r.round_trip for r in done.values()) and len(done) == 7
    assert P.STAGES[-1][1](spark, df.limit(0), sf).count() == 0
