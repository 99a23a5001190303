"""Native operators on odd rows, against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate as D
from sparkloom.llm import license_scan as LS
from sparkloom.llm import license_rules as LR
from sparkloom.llm import quality as Q

SP = r"[^\x20\x09-\x0D]+"


def base_counts(text):
    t = text or ""
    w = re.findall(SP, t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    full = [x for x in t.split("\n") if re.search(SP, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(hit)


TEXTS = [None, "", "   \n\t", "a b c d e f g h i j k.", "x y z w v " * 40, "One good line of plain text here.\nHome | About | Contact\nOne good line of plain text here.\n\n#### $$$$ %%%%", "l\x0bm\x0cn o", "word " * 30000, "This sentence is fine and has more than ten words in it.\nSECOND fine line, with words enough to stay in the text.\nWe use cookies here."]


def test_quality_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string").withColumn("_row", F.lit(1))
    rows = Q.clean(df).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        n, chars, sym, dup, rep = base_counts(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.kept and r.base_failed)
    last = next(r for r in rows if r.doc_id == len(TEXTS) - 1)
    assert last.kept and last.n_lines_removed == 1 and last.cleaned.count("\n") == 1
    assert Q.clean(df).filter("kept").count() == sum(r.kept for r in rows)
    assert Q.clean(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit(7) for c in ("row", "t", "words", "_words", "lines", "good", "grams", "sorted", "same", "at", "a.b")})
    assert Q.clean(clash).columns == [*clash.columns, *Q.OUTPUTS]
    assert sorted((r.doc_id or 0, r.kept) for r in Q.clean(clash).filter("words = 7").collect()) == sorted((r.doc_id or 0, r.kept) for r in rows)
    with pytest.raises(ValueError):
        Q.clean(df.withColumn("kept", F.lit(True)))


def test_other_languages_and_equal_windows(spark):
    body = "Der Fluss entspringt in den Bergen und fließt dann viele Meilen durch offene Felder bis zum Meer, wo er breit und ruhig mündet."
    junk = {"de": "Datenschutzerklärung\nStartseite\nAlle Rechte vorbehalten.", "fr": "Accueil\nPolitique de confidentialité\nMentions légales", "es": "Inicio\nPolítica de privacidad\nIniciar sesión"}
    df = spark.createDataFrame([(k, f"{body}\n{v}") for k, v in junk.items()], "doc_id string, text string")
    assert all(r.kept and r.n_lines_removed == 3 and r.cleaned == body for r in Q.clean(df).collect())


def test_decontamination_catches_substitutions(spark):
    r = random.Random(4)
    vocab = ["v%d" % i for i in range(3000)]
    item = [r.choice(vocab) for _ in range(50)]
    noise = lambda n: [r.choice(vocab) for _ in range(n)]
    changed = [w if k % 7 else "other%d" % k for k, w in enumerate(item)]
    docs = [(1, " ".join(noise(80) + item + noise(80))), (2, " ".join(noise(30) + changed + noise(9))), (3, " ".join(noise(400))), (4, None), (5, ""), (None, " ".join(item).upper()), (6, " ".join(item[:8] + noise(40))), (7, " ".join(noise(20000) + item[10:40])), (1, " ".join(item))]
    tests = [(10, " ".join(item)), (11, "too short here"), (12, None), (13, " ".join(item[:6]) + "!"), (10, " ".join(item)), (14, "Yes, it is"), (15, "nothing")]
    docs += [(8, "and YES it is so, yes it"), (9, " ".join(noise(40) + item[20:33] + noise(40)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "bad": F.lit(1), "a.b": F.lit(2)})
    items = spark.createDataFrame(tests, "item_id long, text string")
    want = {(1, 10), (2, 10), (None, 10), (7, 10), (9, 10), (1, 13), (2, 13), (None, 13), (6, 13), (8, 14)}
    first = D.contaminated(df, items).collect()
    assert {(x.doc_id, x.item_id) for x in first} - {(2, 13)} == want - {(2, 13)}
    for most in (0, 20):  # texts by shuffle as a whole, and only those that agree somewhere
        assert sorted(D.contaminated(df, items, max_broadcast=most).collect(), key=str) == sorted(first, key=str)
    kept = D.drop_contaminated(df, items)
    assert {x.doc_id for x in kept.collect()} == {3, 4, 5, 8} and kept.columns == df.columns
    assert D.contaminated(df.limit(0), items).count() == 0 and D.contaminated(df, items.limit(0)).count() == 0


def test_both_joins_and_the_sql_agree_on_repeated_ids(spark, tmp_path):
    """Several texts under one doc_id and under one item_id, and short items."""
    import duckdb

    r = random.Random(8)
    vocab = ["u%d" % i for i in range(400)]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [some(n) for n in (30, 22, 40, 3, 1, 9)]
    tests = [(1, items[0]), (1, items[1]), (2, items[2]), (2, items[2]), (3, items[3]), (4, items[4]), (None, items[5])]
    docs = [(5, some(20) + items[0][3:25] + some(9)), (5, items[1] + some(30)), (5, items[1] + some(30)), (6, some(5) + items[2][:20] + ["odd"] + items[2][21:]), (6, items[3] + items[5]), (None, items[0] * 2), (7, some(300))]
    spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in tests], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, it = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    rows = lambda x: sorted(((a.doc_id, a.item_id, a.n_windows, round(a.best_share, 9)) for a in x.collect()), key=str)
    want = sorted(((a, b, n, round(s, 9)) for a, b, n, s in con.sql(D.oracle()).fetchall()), key=str)
    assert len(want) >= 5
    assert all(rows(D.contaminated(df, it, max_broadcast=most)) == want for most in (500_000, 20, 0))


def test_a_seed_that_agrees_everywhere(spark):
    """One seed at thousands of places of a text and at several of the item, over more than one stretch."""
    turn = "ab cd ef gh ij "
    docs = spark.createDataFrame([(1, turn * 700), (2, "x " + turn * 3), (3, "y " * 3000)] + [(4, turn * 2)] * 300, "doc_id long, text string")
    items = spark.createDataFrame([(1, turn * 4), (2, turn + "kl mn op qr")], "item_id long, text string")
    rows = lambda most: sorted(map(tuple, D.contaminated(docs, items, max_broadcast=most).collect()))
    want = rows(500_000)
    assert {(d, i) for d, i, *_ in want} >= {(1, 1), (2, 1)} and max(n for *_, n, _ in want) > D.STRETCH
    assert rows(10) == want and rows(0) == want


def licenses(text):
    t = (text or "").translate(str.maketrans(LS.UPPER, LS.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, base = [], set()
    for phrase, label in LS.PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        base |= {label} if hits else set()
    found = []
    for n, r in enumerate(LR.rules()):
        if r.keyword in t:
            found += [(m.start(), -m.end(), r.priority, n, r.label, r.score) for m in re.finditer(r.pattern, t, re.ASCII)]
    found.sort()
    kept = [x for k, x in enumerate(found) if not any(y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] for y in found[:k])]
    labels = ",".join(sorted(base | {x[4] for x in kept}))
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), labels, [(x[4], x[0], -x[1]) for x in kept]


LICENSES = [None, "", "Licensed under the Apache License, Version 2.0 (the License).", "GNU General Public License v3, or the general public\nlicense. All Rights  reserved. ALL rights reserved", "cc by cc-by-sa 4.0 CC BY", "é SPDX-License-Identifier: MPL-2.0-only\nMIT License", "All rights reserved.\n" * 1500, "public\ndomain, do what\n the f*ck you want to public license; MIT\tlicence", "Permission is hereby granted, free of charge, to any person. Copyright (c) 2020 X. All rights reserved."]


def test_licenses_against_python(spark):
    df = spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string").withColumn("lang", F.lit("x"))
    for r in LS.scan(df).collect():
        n, hits, lo, hi, base, labels, kept = licenses(LICENSES[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n, hits, lo, hi, base, labels)
        assert [(d.label, d.start, d.end) for d in r.detections] == kept
        assert 0 <= r.score <= 1
    assert len({r.pattern for r in LR.rules()}) == len(LR.SIGNATURES) > 200
    assert "apache-2.0" in licenses(LICENSES[2])[5] and "apache," not in licenses(LICENSES[2])[5] + ","
    assert LS.scan(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit(7) for c in ("row", "t", "words", "hits", "found", "keep", "at", "base", "x", "a.b")})
    assert LS.scan(clash).columns == [*clash.columns, *LS.OUTPUTS]
    assert sorted((r.doc_id, r.labels) for r in LS.scan(clash).collect()) == sorted((r.doc_id, r.labels) for r in LS.scan(df).collect())
    with pytest.raises(ValueError):
        LS.scan(df.withColumn("score", F.lit(1)))


def test_every_signature_needs_its_keyword():
    """A text made of a signature's own words meets it, and holds its keyword as one run."""
    for r in LR.rules():
        assert " " not in r.keyword and r.keyword in r.pattern.replace("[sc]", "s").replace("licens", "licens").replace("\\", "")


def test_many_detections_take_seconds(spark):
    import time

    text = "All rights reserved.\n" * 100_000
    df = spark.createDataFrame([(1, text), (2, "MIT License")], "doc_id long, text string")
    LS.scan(df.filter("doc_id = 2")).collect()
    t = time.time()
    got = {r.doc_id: r for r in LS.scan(df).select("doc_id", "n_base", "labels", F.size("detections").alias("n")).collect()}
    assert (got[1].n_base, got[1].n, got[1].labels) == (100_000, 100_000, "reserved") and got[2].labels == "mit"
    assert time.time() - t < 60


def test_clean_prose_is_not_taken_for_boilerplate(spark):
    long = "The court read the privacy policy of the firm and found that it said nothing of the sale. " + "It then turned to the letters that the clerk had kept over many years, weighed each of them with care and found for the widow in the end."
    wrapped = "The river rises in the hills to the north of\nthe old town and then runs for many miles through\nopen fields and woods until it meets the sea."
    hindi = "यह एक साफ और लंबा वाक्य है जो पूर्ण विराम पर समाप्त होता है।"
    urdu = "یہ ایک صاف اور لمبا جملہ ہے جو اپنے نشان پر ختم ہوتا ہے۔"
    junk = "cheap shoes buy online best price deals store sale discount\nRead our privacy policy today please"
    df = spark.createDataFrame(list(enumerate([long, wrapped, hindi, urdu, junk])), "doc_id long, text string")
    got = {r.doc_id: r for r in Q.clean(df).collect()}
    assert all(got[i].kept and got[i].n_lines_removed == 0 for i in range(4))
    assert not got[4].kept and got[4].n_lines_removed == 2


def test_rows_are_judged_by_their_own_text(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("clean text number "), F.col("id").cast("string")).alias("text"))
    leak = spark.createDataFrame([(None, f"so {passage} then"), (7, f"so {passage} then"), (7, "clean too"), (8, None), (9, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for most in (500_000, 0):
        kept = D.drop_contaminated(docs.union(leak), items, max_broadcast=most)
        assert kept.count() == 10_003 and kept.filter("text LIKE '%w3 %'").count() == 0
