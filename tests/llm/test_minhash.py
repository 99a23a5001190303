import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import minhash as M
from sparkloom.llm.components import components


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def bag(t):
    w = words(t)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(a, b):
    x, y = ({k: 1 + math.log(n) for k, n in bag(t).items()} for t in (a, b))
    if not x or not y:
        return 0.0
    plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    prob = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    return max(plain, prob)


def classes(texts, threshold=0.8):
    """Union-find over all pairs of texts; equal words are linked whatever their number."""
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is not None and texts[j] is not None and (words(texts[i]) == words(texts[j]) or brute(texts[i], texts[j]) >= threshold):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def sample(seed, n_base=12, copies=4):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["é%d" % i for i in range(20)]
    out = []
    for _ in range(n_base):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 9, 60, 150]))]
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(", ".join(w) if r.random() < 0.3 else " ".join(w))
    return out


def test_exact_similarity_and_word_hashes():
    texts = sample(3) + ["a b c d e " * 6, "a b c d e " * 3 + "f g h i j", "", "!!", "Ä b"]
    h, counts = M.word_hashes(texts)
    assert list(counts) == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(flat, h)) and len(set(h.tolist())) == len(set(flat))
    o, w, c = M.weighted(*M.shingles(h, counts))
    cuts = np.searchsorted(o, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        assert sorted(c[cuts[i] : cuts[i + 1]]) == sorted(bag(texts[i]).values())
        for j in range(i):
            got = M.similarity(w[cuts[i] : cuts[i + 1]], c[cuts[i] : cuts[i + 1]], w[cuts[j] : cuts[j + 1]], c[cuts[j] : cuts[j + 1]])
            assert abs(got - brute(texts[i], texts[j])) < 1e-9


def test_registers_estimate_the_similarity():
    r = random.Random(1)
    base = ["w%d" % r.randrange(900) for _ in range(300)]
    near = base[:270] + ["x%d" % i for i in range(30)]
    texts = [" ".join(base), " ".join(near)]
    o, w, c = M.weighted(*M.shingles(*M.word_hashes(texts)))
    got = M.sketch(o, w, c, 2, m=4096)
    assert abs((got[0] == got[1]).mean() - brute(*texts)) < 0.04


def test_classes_against_brute_force(spark):
    texts = [*sample(5), *sample(5)[:8], None, None, "", "...", "one two", "One, two!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("class_id", F.lit("x")).repartition(3)
    got = {r.doc_id: r.class_id for r in M.near_duplicate_classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)
    kept = {r.doc_id for r in M.keep_one(df).collect()}
    assert kept == {i for i, c in got.items() if i == c}


def test_classes_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(M.near_duplicate_classes(df).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, None), (1, 1), (1, 1), (2, 2)], key=str)
    assert M.keep_one(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"text": "gone_id"}).withColumns({"gone_mark": F.lit(1), "class_id": F.lit(2), "a.b": F.lit(3)})
    kept = M.keep_one(clash, text="gone_id")
    assert kept.columns == clash.columns and kept.count() == 4


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "pq")
    rows = [(7, a), (7, b), (8, b + " tail"), (9, a + " tail"), (9, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, M.near_duplicate_classes(df).collect())) == [(7, 7), (7, 7), (8, 7), (9, 7), (9, 9)]
    assert sorted(map(tuple, M.keep_one(df).collect())) == sorted([(7, a), (7, b), (9, "alone")])


def test_a_very_long_text_meets_its_copy(spark):
    long = " ".join("w%d" % (i * 7919 % 50021) for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " one more"), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in M.near_duplicate_classes(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_recall_on_documents(spark):
    """Links of the module's own similarity at 0.8 or more, by brute force over shared shingles."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text}
    o, w, c = M.weighted(*M.shingles(*M.word_hashes(list(docs.values()))))
    cuts = np.searchsorted(o, np.arange(len(docs) + 1))
    sets = {i: (w[x:y], c[x:y]) for i, x, y in zip(docs, cuts, cuts[1:])}
    by = defaultdict(list)
    for i, (hashes, _) in sets.items():
        for x in hashes.tolist():
            by[x].append(i)
    shared = Counter((a, b) for v in by.values() for a in v for b in v if a < b)
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.3 * min(len(sets[a][0]), len(sets[b][0])) and M.similarity(*sets[a], *sets[b]) >= 0.8]
    got = {r.doc_id: r.class_id for r in M.near_duplicate_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    linked = sum(got[a] == got[b] for a, b in near)
    assert len(near) > 50 and linked >= 0.99 * len(near)


@pytest.mark.parametrize(("block", "times"), [(10, 20), (5, 60)])
def test_recall_on_repeated_blocks(spark, block, times):
    rows = []
    for k in range(60):
        w = [f"b{k}x{i}" for i in range(150)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + w[70 : 70 + block] * times))]
    pairs = [(x, y) for (_, x), (_, y) in zip(rows[::2], rows[1::2])]
    assert all(brute(x, y) >= 0.8 for x, y in pairs)
    got = {r.doc_id: r.class_id for r in M.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(60)) == 60


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)


def test_members_that_miss_the_bucket_leader_are_linked(spark):
    """A chain of texts: neighbours are similar, the ends are not, so leaders miss most links."""
    r = random.Random(9)
    words_ = ["c%d" % r.randrange(5000) for _ in range(400)]
    texts = []
    for k in range(24):
        texts.append(" ".join(words_[k * 9 : k * 9 + 150]))
    texts += [" ".join("z%d" % r.randrange(5000) for _ in range(150)) for _ in range(5)]
    df = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in M.near_duplicate_classes(df).collect()}
    order = [texts[len(texts) - i] for i in range(1, len(texts) + 1)]
    assert [got[i + 1] - 1 for i in range(len(texts))] == classes(order)


def test_repeated_passages_meet(spark):
    """Plain Jaccard of 0.98, probability Jaccard of 0.65: linked though the weighted registers part,
    also where the pairs meet outside their bucket's least member."""
    rows = []
    for k in range(40):
        w = [f"t{k}x{i}" for i in range(204)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + w[-64:] * 19))]
    got = {r.doc_id: r.class_id for r in M.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(a[1], b[1]) for a, b in zip(rows[::2], rows[1::2])]
    assert all(brute(a, b) >= 0.8 for a, b in pairs)
    assert got == {i: i - i % 2 for i in range(80)}


def test_every_pair_across_components_is_verified(spark):
    """Two components of one bucket whose only link has a low probability Jaccard."""
    w = [f"q{i}" for i in range(204)]
    texts = {1: "lone text of the bucket that is not like others at all", 2: " ".join(w), 3: " ".join(w + w[-64:] * 19)}
    docs = M._source(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "text", "doc_id")
    sketched = M._sketches(docs)
    ids = {r.doc_id: r.id for r in sketched.collect()}
    bands = {r.doc_id: list(r.bands) for r in sketched.collect()}
    key = next(k for k in bands[2] if k in bands[3])
    vertices = sketched.select("id", F.col("doc_id").alias("rep"), "mark")
    rest = spark.createDataFrame([(key, ids[i], ids[i]) for i in (2, 3)], "key long, id long, root long")
    assert [tuple(r) for r in M._across(rest, sketched, vertices, docs, 0.8).collect()] == [tuple(sorted((ids[2], ids[3])))]
