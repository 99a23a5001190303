"""Mentions and answers in long sessions against plain loops."""

import random
import time

from pyspark.sql import functions as F

from sparkloom.operators import mentions, waste as W


def test_mentions_are_substrings_in_any_block(spark):
    rng = random.Random(1)
    names = ["a.ts", "b.ts", "aa.ts", "", "ä b.ts", "(x)", "never.py", "a.t"]
    texts = [(s, i, rng.choice(["see a.ts", "xaa.tsx", "the ä b.ts!", "f(x)", "nothing", "b.t s", "a.t"]) + rng.choice(["", " b.ts"])) for s in (1, 2) for i in range(0, 90, 2)]
    sought = [(1, n) for n in names] + [(2, "a.ts"), (3, "a.ts"), (2, "a.ts")]
    got = mentions.last_mentions(spark.createDataFrame(sought, "session_id long, name string"), spark.createDataFrame(texts, "session_id long, idx long, text string").repartition(3), block=16)
    want = {(s, n, max(i for t, i, x in texts if t == s and n in x)) for s, n in sought if any(t == s and n in x for t, _, x in texts)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_ten_thousand_names_and_texts_in_one_session(spark):
    names = spark.range(10_000).select(F.lit(7).alias("session_id"), F.concat(F.lit("f"), "id", F.lit(".ts")).alias("name"))
    texts = spark.range(10_000).select(F.lit(7).alias("session_id"), F.col("id").alias("idx"), F.concat(F.lit("see f"), F.col("id") % 4000, F.lit(".ts and more words")).alias("text"))
    began = time.time()
    got = mentions.last_mentions(names, texts).collect()
    assert time.time() - began < 30
    assert {(r.name, r.ti) for r in got} == {(f"f{k}.ts", max(i for i in range(k, 10_000, 4000))) for k in range(4000)}


def test_answers_are_sought_by_equality(spark):
    block = "array<struct<type:string,text:string,thinking:string,signature:string,name:string,input_json:string,id:string,tool_use_id:string,is_error:boolean,content_kind:string,content_str:string,sub:array<string>>>"
    rng = random.Random(2)
    rows, want = [], set()
    kinds = [rng.choice(["result", "short", "long", "other"]) for _ in range(300)]
    for i, k in enumerate(kinds):
        body = (str(i) + "y" * 250)[:250]
        one = {"result": ("tool_result", None, body), "short": ("text", "ok", None), "long": ("text", "w" * 60, None), "other": ("text", "u", None)}[k]
        b = [(one[0], one[1], None, None, None, None, None, None, None, "string" if one[2] else None, one[2], None)]
        rows.append((1, i, "user" if k in ("result", "other") else "assistant", 150, b))
        if k == "result" and "long" not in kinds[i + 1 : i + 5]:
            want.add(i)
    df = spark.createDataFrame(rows, f"session_id long, idx long, type string, tokens long, blocks {block}")
    found = W.unused_results(df)
    assert {r.first_idx for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
