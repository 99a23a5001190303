"""Logs that are appended to, configuration of many projects, pages by tasks, scans of long sessions."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import analyze, reports as R, scan
from sparkloom.sources import logs, sinks, state
from sparkloom.sources.appends import AppendLog, ordered_lines
from sparkloom.sources.configs import config_files, project_configs

from .test_engine import ask, reply



def test_an_append_counts_once(spark, tmp_path):
    log = AppendLog((tmp_path / "log").as_uri())
    rows = lambda *xs: spark.createDataFrame(xs, "sessionId string, timestamp string, totalTokens long").repartition(3)
    assert log.lines(spark).count() == 0
    assert log.append(rows(("a", "1", 10), ("b", "1", 20)), 0, "totalTokens")
    assert not log.append(rows(("a", "9", 99)), 0)
    # a run without its mark was interrupted and is written anew
    (tmp_path / "log" / "runs" / "1").mkdir()
    (tmp_path / "log" / "runs" / "1" / "part-0.json").write_text(json.dumps({"sessionId": "lost"}) + "\n")
    assert log.lines(spark).count() == 2
    assert log.append(rows(("a", "2", 11), ("a", "2", 12), ("c", "1", 30)), 1, "totalTokens")
    log.append(rows(("b", "0", 21)), 2)
    newest = lambda: {(r.session_id, r.ts, r.total_tokens) for r in R.trend_history(state.trend_records(log.lines(spark))).collect()}
    want = {("a", "2", 11), ("b", "1", 20), ("c", "1", 30)}
    assert newest() == want
    for upto in (1, 1, 2):
        log.fold(spark, upto, "sessionId", "timestamp")
        assert newest() == want
    assert not log.append(rows(("a", "9", 99)), 1) and log.lines(spark).count() == 3
    assert not (tmp_path / "log" / "runs" / "0").exists()


def test_a_long_log_is_read_in_order_by_many_tasks(spark, tmp_path):
    (tmp_path / "history.jsonl").write_text("".join(json.dumps({"sessionId": f"s{i % 7}", "timestamp": f"{i:06d}", "totalTokens": i}) + "\r\n" + ("junk\n" if i % 50 == 0 else "") for i in range(4000)))
    (tmp_path / "notes.jsonl").write_text("".join(json.dumps({"sessionId": "s", "timestamp": str(i), "percentUsed": 1.5, "threshold": 2.0, "text": "t"} if i % 3 else {"sessionId": "s"}) + "\n" for i in range(900)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert ordered_lines(spark, str(tmp_path / "history.jsonl")).rdd.getNumPartitions() > 5
        rows = state.read_trend_log(spark, str(tmp_path / "history.jsonl")).orderBy("line").collect()
        assert [r.total_tokens for r in rows] == list(range(4000))
        assert {r.total_tokens for r in R.trend_history(state.read_trend_log(spark, str(tmp_path / "history.jsonl"))).collect()} == set(range(3993, 4000))
        notes = sinks.read_log(spark, str(tmp_path / "notes.jsonl"), 5).collect()
        assert [r.timestamp for r in notes] == ["899", "898", "896", "895", "893"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_configuration_of_two_projects(spark, tmp_path):
    home = tmp_path / "home"
    for name, size in (("p", 4_000), ("q", 400)):
        for folder in ("a", "b"):
            (home / name / "mem" / folder).mkdir(parents=True)
        (home / name / "PROMPT.md").write_text("x" * size)
        (home / name / "mem" / "MEMORY.md").write_text("[1](a/x.md) [2](b/x.md) [3](a/x.md) [4](none.md)")
        (home / name / "mem" / "a" / "x.md").write_text("y" * size)
        (home / name / "mem" / "b" / "x.md").write_text("z" * 40)
        (home / name / "own.json").write_text(json.dumps({"mcpServers": {"g1": {}, name: {}}, "skills": {"s1": 1, f"s-{name}": 2}}))
    (home / "all.json").write_text('﻿{"mcpServers": {"g1": {}}, "skills": ["s1", {"name": "s2"}]}')
    (home / "r.json").write_text("{broken")
    at = lambda *x: (home.joinpath(*x)).as_uri()
    projects = spark.createDataFrame(
        [(n, [at(n, "NONE.md"), at(n, "PROMPT.md"), at(n, "mem", "MEMORY.md"), at(n, "mem", "a", "x.md")], at(n, "mem"), at("all.json"), at(n, "own.json")) for n in ("p", "q")]
        + [("r", [], at("nowhere"), at("nowhere.json"), at("r.json")), ("s", None, None, None, None)],
        "project string, prompt_paths array<string>, memory_dir string, global_json string, project_json string",
    )
    got = {r.project: (r.prompt, r.memory, r.skill_tokens, r.servers, r.skills) for r in project_configs(projects, config_files(spark, home.as_uri())).collect()}
    index = 12
    assert got == {
        "p": (1_000 + index, index + 1_000 + 10 + 1_000, 180, ["g1", "p"], ["s1", "s2", "s-p"]),
        "q": (100 + index, index + 100 + 10 + 100, 180, ["g1", "q"], ["s1", "s2", "s-q"]),
        "r": (0, 0, 0, [], []),
        "s": (0, 0, 0, [], []),
    }
    for n in "pqt":
        (tmp_path / "logs" / n).mkdir(parents=True)
        (tmp_path / "logs" / n / "x.jsonl").write_text("\n".join([ask("a"), reply(20_000, out=10)]) + "\n")
    m = logs.read_sessions(spark, str(tmp_path / "logs" / "*" / "*.jsonl"))
    a = analyze.analyze(m, configs=project_configs(projects, config_files(spark, home.as_uri())))
    b = {(r.session_id, r.category): r.tokens for r in a.buckets.collect()}
    derived = {r.session_id: r.tokens for r in a.derived.collect()}
    assert derived == {"p/x": 20_000 - 1_012 - 9_055 - 2_022 - 180 - 1, "q/x": 20_000 - 112 - 9_055 - 222 - 180 - 1, "t/x": 20_000 - 9_055 - 476 - 1}
    assert (b["p/x", "system"], b["q/x", "system"], b["p/x", "state"], b["q/x", "state"], b["t/x", "state"]) == (1_012 + derived["p/x"], 112 + derived["q/x"], 2_022, 222, 0)


def test_pages_are_written_by_tasks(spark, tmp_path):
    ids = spark.range(500).select(F.concat(F.lit("p/<s>"), "id").alias("session_id"), F.col("id").alias("total"), (F.col("id") / 7).alias("percentage"))
    many = ids.filter("total < 3").select("session_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("rank"), F.lit('a "b" & <c>').alias("note"))
    paths = sinks.write_sessions(sinks.page_lines({"Window": (ids, []), "Waste": (many, ["rank"])}), tmp_path.as_uri(), suffix=".html")
    assert paths.count() == 500
    files = sorted((tmp_path / "pages").iterdir())
    assert len(files) == 500
    one = (tmp_path / "pages" / "p%2F%3Cs%3E2.html").read_text()
    assert one.startswith("<!doctype html>") and one.endswith("</body></html>\n") and "<h1>Session p/&lt;s&gt;2</h1>" in one
    assert [int(x) for x in __import__("re").findall(r"<tr><td>(\d+)</td><td>a &quot;b&quot; &amp; &lt;c&gt;", one)] == list(range(12))
    pairs = spark.createDataFrame([("a", "b", "tools", 1, 3, 2, 200.0)], "session_a string, session_b string, category string, tokens_a long, tokens_b long, delta long, delta_percent double")
    said = spark.createDataFrame([("a", "b", "first\nsecond")], "session_a string, session_b string, insights string")
    lines = [r.line for r in sinks.comparison_pages(pairs, said).orderBy("pos").collect()]
    assert [x for x in lines if "second" in x] == ["<tr><td>1</td><td>second</td></tr>"] and "<h1>Comparison of a and b</h1>" in lines[0]


@pytest.mark.parametrize("block", [4, 64])
def test_scans_equal_windows(spark, block):
    df = spark.range(600).select((F.col("id") % 3).alias("session_id"), F.floor(F.col("id") / 3).alias("idx"), F.when(F.col("id") % 5 < 3, F.col("id") % 11).alias("v"), F.floor(F.col("id") / 47).alias("k"), F.when(F.col("id") % 40 > 36, F.col("id")).alias("rare"))
    w = Window.partitionBy("session_id").orderBy("idx")
    want = df.withColumns({"a": F.sum("v").over(w), "b": F.last("rare", ignorenulls=True).over(w), "c": F.last("rare", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "d": F.sum("v").over(w.rowsBetween(-3, -1))})
    starts = F.when(F.lag("k").over(w).eqNullSafe(F.col("k")) & (F.col("idx") > 0), 0).otherwise(1)
    want = want.withColumn("s", starts).withColumn("e", F.sum("s").over(w)).drop("s")
    got = scan.running_sum(df, "v", "a", block)
    got = scan.last_value(scan.last_value(got, "rare", "b", block), "rare", "c", block, before=True)
    got = scan.islands(scan.moving_sum(got, "v", 3, "d", block), "k", "e", block)
    columns = ["session_id", "idx", "a", "b", "c", "d", "e"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_one_long_session_is_many_tasks_work(spark):
    df = spark.range(2_000_000).select(F.lit(1).alias("session_id"), F.col("id").alias("idx"), F.lit(1).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scan.running_sum(df, "v", "a", 1 << 12)
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).select("count(1)").collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
        assert out.filter("a <> idx + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
