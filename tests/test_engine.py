"""The session engine on small logs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.schema import message_schema
from sparkloom.operators import advice, analyze, classify as C, compaction as K, reports as R, waste as W
from sparkloom.sources import doctor, logs, sinks, state
from sparkloom.streaming import live


def line(type_, content=None, usage=None, model=None, **top):
    m = {"role": type_, "content": content}
    if usage:
        m["usage"] = dict(zip(("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"), usage))
    if model:
        m["model"] = model
    return json.dumps({"type": type_, **({"message": m} if content is not None else {}), **top})


def ask(text):
    return line("user", [{"type": "text", "text": text}])


def reply(n, text="ok", out=100, model="model-a", cache=0):
    return line("assistant", [{"type": "text", "text": text}], (n, out, 0, cache), model)


def call(path, id_, name="Read"):
    return line("assistant", [{"type": "tool_use", "id": id_, "name": name, "input": {"file_path": path}}], (10, 0, 0, 0))


def result(id_, text, **kw):
    return line("user", [{"type": "tool_result", "tool_use_id": id_, "content": text, **kw}])


def boundary(pre):
    return line("system", subtype="compact_boundary", isMeta=True, compactMetadata={"trigger": "auto", "preTokens": pre})


@pytest.fixture
def read(spark, tmp_path):
    def go(*lines_, name="s1"):
        d = tmp_path / "proj"
        d.mkdir(exist_ok=True)
        (d / f"{name}.jsonl").write_text("\n".join(lines_) + "\n")
        return logs.read_sessions(spark, str(d / f"{name}.jsonl"))

    return go


def test_log_rows(spark, read, tmp_path):
    m = read(ask("hi"), "", "{bad", line("progress"), json.dumps({"type": "assistant", "model": "<synthetic>", "message": {"role": "assistant", "content": "x"}}), line("assistant", "plain", (5, 7, 1, 2), "m"), line("user", "[1]"), result("t1", [{"type": "text", "text": "inner"}]))
    rows = m.orderBy("idx").collect()
    assert m.schema.fieldNames() == message_schema().fieldNames()
    assert [(r.idx, r.type, r.content_kind) for r in rows] == [(0, "user", "array"), (1, "assistant", "string"), (2, "user", "string"), (3, "user", "array")]
    assert rows[2].content_str == "[1]" and rows[3].blocks[0].sub[0].text == "inner"
    assert logs.malformed_lines(spark, str(tmp_path / "proj" / "s1.jsonl")).first().n_malformed == 1
    found = logs.discover_sessions(spark, str(tmp_path)).collect()
    assert [(r.session_id, r.project) for r in found] == [("s1", "proj")]
    assert logs.project_path("C--work-app") == "C:/work/app"


def test_tokens(spark):
    df = spark.createDataFrame([("plain text here",), ("const x = 1",), ("😀😀",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.tokens_of(F.col("t"))).collect()] == [4, 4, 1, 0, 0]


def test_categories(read):
    m = read(ask("Read system prompt first"), call("a.ts", "t1"), result("t1", "x"), line("assistant", [{"type": "text", "text": "see"}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "ls"}}]), result("t2", "out"), ask("plan_mode on"), ask("last"), reply(5))
    got = [(r.category, r.tool_name) for r in C.classify(m).orderBy("idx").collect()]
    assert got == [("system", None), ("retrieved", "Read"), ("retrieved", "Read"), ("conversation", None), ("tools", "Bash"), ("state", None), ("user", None), ("conversation", None)]
    b = {r.category: r for r in C.buckets(C.classify(m)).collect()}
    assert len(b) == 6 and abs(sum(r.percentage for r in b.values()) - 100) < 1e-9


def test_compaction_by_marker_and_by_fall(read):
    m = read(ask("a"), reply(90_000), boundary(95_000), line("user", "sum" * 7, isCompactSummary=True), ask("b"), reply(20_000), reply(60_000), reply(29_000), name="m1")
    e = K.compaction_events(m).collect()
    assert [(x.before_idx, x.after_idx, x.tokens_before, x.tokens_after, x.summary_idx, x.summary_tokens, x.detection) for x in e] == [(2, 5, 95_000, 20_000, 3, 6, "marker")]
    start = K.last_compaction(K.compaction_events(m)).first().start_idx
    assert start == 5
    h = read(reply(90_000), reply(60_000), reply(29_999), name="h1")
    assert [(x.before_idx, x.after_idx, x.detection) for x in K.compaction_events(h).collect()] == [(1, 2, "heuristic")]


def test_window_is_the_last_real_call(read):
    m = read(ask("a"), reply(100, cache=50), reply(200, cache=60), reply(0, model="<synthetic>"))
    assert C.effective_window(m).first().effective == 260
    assert C.effective_window(read(ask("only"), name="n")).first().effective is None


def test_limits_and_models(spark, read):
    df = spark.createDataFrame([("model-x[1m]",), ("model-x-1M",), ("model-1m-x",), (None,)], "m string")
    assert [r[0] for r in df.select(X.context_limit(F.col("m"))).collect()] == [1_000_000, 1_000_000, 200_000, 200_000]
    m = read(reply(1, model="a"), reply(1, model="b"), reply(1, model="<synthetic>"), reply(1, model="a"))
    seg = K.model_segments(m)
    assert [r.model for r in seg.orderBy("segment").collect()] == ["a", "b", "a"]
    h = K.model_history(seg).first()
    assert (h.current_model, h.n_switches, h.n_models, h.models) == ("a", 2, 2, "a,b")
    over = read(reply(200_001, model="a"), name="o")
    lim = C.context_limits(over, K.model_history(K.model_segments(over)).select("session_id", "current_model")).first()
    assert (lim.context_limit, lim.signal) == (1_000_000, "usage")


def test_waste_and_focus(read):
    big = "word " * 200
    filler = [reply(10, "done and more text than fifty characters, so that it counts") for _ in range(16)]
    m = read(call("src/A.ts", "t1"), result("t1", big), call("src/a.ts", "t2"), result("t2", big), *filler, call("x", "t3", "Bash"), result("t3", big), ask("thanks"), ask("end"))
    c = C.classify(m)
    since = K.last_compaction(K.compaction_events(m))
    w = W.detect_waste(c, m, since).orderBy("rank").collect()
    assert [x.type for x in w] == ["resolved_exchange", "stale_read", "stale_read", "duplicate_read", "unused_result"]
    dup = next(x for x in w if x.type == "duplicate_read")
    assert (dup.filename, dup.n_reads, dup.detail, dup.first_idx, dup.last_idx) == ("A.ts", 2, "1", 0, 1)
    focus = advice.compact_focus(W.detect_waste(c, m, since)).first().focus
    assert focus.startswith('/compact focus "drop resolved exchange at messages #') and focus.count(";") == 2
    edited = read(call("a.ts", "t1"), result("t1", big), call("a.ts", "e", "Edit"), call("a.ts", "t2"), result("t2", big), name="e1")
    assert W.duplicate_reads(C.classify(edited)).count() == 0


def test_cutoff(read):
    own = line("assistant", [{"type": "tool_use", "id": "z", "name": "Bash", "input": {"command": "tool analyze"}}])
    m = read(ask("work"), reply(5), ask("analyze"), line("assistant", [{"type": "thinking", "thinking": "hm"}]), own, result("z", "REPORT"))
    b = F.get("blocks", F.lit(0))
    got = C.cutoff(m, F.coalesce(b["input_json"].contains("analyze"), F.lit(False)), F.coalesce(b["content_str"].contains("REPORT"), F.lit(False))).first()
    assert (got.n, got.cutoff) == (6, 2)
    none = read(ask("work"), reply(5), name="n2")
    assert C.cutoff(none, F.lit(False), F.lit(False)).first().cutoff == 2


def test_trend(spark):
    def summary(ps):
        rows = [("g", f"s{i}", f"2024-01-{i + 1:02d}", i, "p", float(p), "tools" if i % 2 else "user") for i, p in enumerate(ps)]
        df = spark.createDataFrame(rows, "g string, session_id string, ts string, line int, project string, percent_used double, top_category string")
        return R.trend_summary(R.trend_history(df), "g").first()

    assert summary([10, 10, 30]).direction == "worsening" and summary([30, 20, 10]).direction == "improving"
    assert summary([10, 11, 12]).direction == "flat" and summary([10, 90]).direction == "flat"
    assert summary([1, 1, 1, 1]).dominant_category == "user"
    df = spark.createDataFrame([("s", "t1", 1, 'a,"b"', 1.0), ("s", "t2", 2, "x", None), ("s", "t2", 3, "y", 2.0)], "session_id string, ts string, line int, project string, percent_used double")
    h = R.trend_history(df)
    assert [r.line for r in h.collect()] == [2]
    assert R.trend_csv(df.filter("line = 1"), ("project", "percent_used")).first().line == '"a,""b""",1.00'


def test_calibration(spark):
    full = "System prompt: 3,000\n  System tools:  9,100 TOKENS\nMCP tools: 500 tokens\nMemory files: 250 tokens\nMessages: 40,000 tokens\nTotal: 60,000 tokens\nFree space: 7,150"
    rows = [(1, full), (2, "System prompt: 70\nMessages: 900"), (3, ""), (4, "nothing to read"), (5, "Messages: 12 tokens\nFree space: 30"), (6, "Tools: 11k\nTools: 12\nTools: 3\nmcp server: 0\nMCP: 4"), (7, None)]
    actual = R.parse_context_output(spark.createDataFrame(rows, "id int, text string"))
    got = {r.id: r for r in actual.collect()}
    assert sorted(got) == [1, 2, 5, 6]
    one = got[1]
    assert (one.system_prompt, one.system_tools, one.custom_agents, one.memory_files, one.mcp_tools, one.messages, one.free_space, one.total_capacity) == (3_000, 9_100, 0, 250, 500, 40_000, 7_150, 60_000)
    assert (got[2].system_prompt, got[2].messages) == (70, 900)
    assert (got[5].total_used, got[5].total_capacity) == (12, 42)
    assert (got[6].system_tools, got[6].mcp_tools) == (3, 0)
    est = spark.createDataFrame([(1, "system", 1_500), (1, "tools", 9_600), (1, "user", 20_000), (1, "conversation", 20_000), (1, "state", 0)], "id int, category string, tokens bigint")
    compared = R.calibrate(est, actual)
    assert {r.bucket: (r.estimated, r.actual, r.delta_percent) for r in compared.collect()} == {"System prompt": (1_500, 3_000, -50.0), "Tools": (9_600, 9_600, 0.0), "Messages": (40_000, 40_000, 0.0), "Memory": (0, 250, -100.0)}
    # 9,100 alone are within 5 % of the table, with the servers' 500 they are not
    acc = R.calibration_accuracy(compared).first()
    assert abs(acc.accuracy - (100 - 1_750 / 52_850 * 100)) < 1e-9 and acc.stale


def test_file_refs_and_terms(spark):
    df = spark.createDataFrame([("See src/a.ts, ./b.md and C:\\x\\y.py; v1.2.3, e.g. x.zzz a.ts",), (None,)], "t string")
    got = df.select(X.file_refs(F.col("t"))).collect()
    assert got[0][0] == ["./b.md", "C:\\x\\y.py", "a.ts", "src/a.ts"] and got[1][0] == []
    one = spark.createDataFrame([("open main.rs and call parseFile (x) quickly-done",)], "t string")
    assert one.select(X.key_terms(F.col("t"))).first()[0] == ["main.rs", "parseFile", "parseFile", "quicklydone"]


def test_decisions_fold_and_stream_agree(spark, tmp_path):
    rows = [("a", t, p) for t, p in ((0, 90.0), (50, 95.0), (100, 20.0), (120, 99.0), (400, 91.0))] + [("b", 10, 10.0), ("b", 20, 80.0)]
    df = spark.createDataFrame(rows, "session_id string, ts_ms long, percentage double")
    want = {("a", 0), ("a", 120), ("a", 400), ("b", 20)}
    assert {tuple(r) for r in advice.injection_decisions(df, 80, 100).collect()} == want
    df.write.parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "turns"))
    assert {tuple(r) for r in live.run_once(live.throttled(stream, 80, 100), (tmp_path / "o").as_uri()).collect()} == want


def test_any_cut_is_that_cut_analysed(read):
    rows = [ask("a"), call("f", "t1"), result("t1", "x" * 50), result("t2", "y" * 30), ask("b plan_mode"), call("g", "t2", "Bash"), result("t2", "z" * 70), call("g", "t1", "Bash"), line("user", "c"), line("user", "s", isCompactSummary=True), call("h", "t2"), result("t1", "w")]
    m = read(*rows)
    cuts = (0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 40)
    got = {}
    for r in R.cut_buckets(m, cuts).collect():
        got.setdefault(r.cut, set()).add((r.category, r.tokens, r.n_messages, r.accuracy))
    assert sorted(got) == sorted({max(1, c) for c in cuts})
    for c in got:
        alone = C.buckets(C.classify(m.filter(F.col("idx") < c)))
        assert got[c] == {(r.category, r.tokens, r.n_messages, r.accuracy) for r in alone.collect()}, c


def test_quotes_in_names_are_escaped(spark):
    rows = [("s", 1, "high", "stale_read", 'a"b\\c.ts', 50, 0, 0, 0)]
    df = spark.createDataFrame(rows, "session_id string, rank int, severity string, type string, filename string, tokens long, rel_first long, first_idx long, last_idx long")
    assert advice.compact_focus(df).first().focus == '/compact focus "drop stale read of a\\"b\\\\c.ts"'


def test_cuts_and_diff(read):
    m = read(ask("a"), reply(5, out=10), ask("b"), reply(6, out=20))
    got = R.session_diff(R.cut_buckets(m, (1, 9)), 1, 9).collect()
    assert {r.category: (r.tokens_from, r.tokens_to) for r in got}["conversation"] == (0, 31)
    with pytest.raises(ValueError):
        R.session_diff(R.cut_buckets(m, (1, 9)), 9, 1)


def test_whole_analysis_and_reports(spark, read, tmp_path):
    m = read(ask("a"), reply(50_000, out=10), ask("b"), reply(60_000, out=20))
    a = analyze.analyze(m, prompt=100, cache=True)
    s = a.state.first()
    assert (s.total, s.context_limit, s.n_messages, s.health) == (60_000, 200_000, 4, "healthy")
    assert {r.category: r.tokens for r in a.buckets.collect()}["tools"] == 9_055
    md = sinks.markdown_table(a.buckets, "Window")
    assert md.count("\n") == 10
    assert "<table>" in sinks.html_report({"w": a.state}, "Report") and "1 more rows" in sinks.html_report({"w": a.buckets}, "R", rows=5)
    pages = {r.line for r in sinks.session_pages(a).collect()}
    assert sum(x.startswith("<h2>") for x in pages) == 4 and "<tr><td>tools</td><td>9055</td><td>0</td><td>estimated</td><td>98.6<div class='bar' style='width:98.6px'></div></td></tr>" in pages, pages
    assert "5 more rows" in sinks.markdown_table(a.buckets, "W", rows=1)
    shown = sinks.text_table(a.buckets.select("category", "tokens").orderBy("category")).split("\n")
    assert shown[0].startswith("category") and shown[2].endswith(" 31") and len(shown) == 9
    odd = spark.createDataFrame([("a,b", 1), ('say "x"', None)], "t string, n int")
    sinks.to_csv(odd, str(tmp_path / "csv"))
    lines = {x.value for x in spark.read.text(str(tmp_path / "csv")).collect()}
    assert lines == {"t,n", '"a,b",1', '"say ""x""",'}
    assert sinks.fixed(0.15, 1) == "0.1" and sinks.sparkline([0, 7]) == "▁█"


def test_boundary_lines(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text(ask("a") + "\n" + ask("compact_boundary") + "\n" + boundary(5) + "\n")
    assert live.boundary_lines(spark.read.text(str(f))).count() == 1


def test_equal_names_in_two_projects(spark, tmp_path):
    for project in "pq":
        (tmp_path / project).mkdir()
        (tmp_path / project / "s.jsonl").write_text("\r\n".join(ask(f"{project}{i}") for i in range(50)))
    m = logs.read_sessions(spark, str(tmp_path / "*" / "*.jsonl"))
    got = {(r.session_id, r.idx): r.blocks[0].text for r in m.collect()}
    assert got == {(f"{p}/s", i): f"{p}{i}" for p in "pq" for i in range(50)}
    found = logs.discover_sessions(spark, str(tmp_path)).collect()
    assert {(r.session_id, r.session_key) for r in found} == {("s", "p/s"), ("s", "q/s")}


def test_a_split_log_keeps_its_order(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "long.jsonl").write_text("\n".join(ask(f"{i} " + "x" * (i % 90)) for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        m = logs.read_sessions(spark, str(tmp_path / "p" / "long.jsonl"))
        rows = m.select("idx", F.get("blocks", F.lit(0))["text"].alias("t")).orderBy("idx").collect()
        assert [int(r.t.split()[0]) for r in rows] == [r.idx for r in rows] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_own_turn_is_left_out(read):
    own = line("assistant", [{"type": "tool_use", "id": "z", "name": "Bash", "input": {"command": "sparkloom waste --json"}}])
    m = read(ask("work"), reply(5), ask("waste?"), own, result("z", "sparkloom report: 3"))
    assert C.without_own_turn(m).count() == 2
    assert C.without_own_turn(read(ask("work"), reply(5), ask("go on"), name="o2")).count() == 3


def test_config_scan(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"p{k}.md").write_text("x" * (4 * k + 1))
    mem = tmp_path / "mem"
    mem.mkdir()
    (mem / "MEMORY.md").write_text("[a](one.md) [b](one.md) [c](none.md) [d](a/x.md) [e](b/x.md)")
    (mem / "one.md").write_text("y" * 40)
    for folder, n in (("a", 4), ("b", 400)):  # of one name, each counts once
        (mem / folder).mkdir()
        (mem / folder / "x.md").write_text("z" * n)
    (tmp_path / "g.json").write_text('\ufeff{"mcpServers": {"a": {}, "b": {}}, "skills": ["s1", {"name": "s2"}]}')
    (tmp_path / "l.json").write_text('{"mcpServers": {"b": {}, "c": {}}, "skills": {"s1": 1, "s3": 2}}')
    got = logs.gather_config(spark, [str(tmp_path / f) for f in ("none.md", "p1.md", "p2.md", "p3.md")], str(mem), str(tmp_path / "g.json"), str(tmp_path / "l.json"))
    assert (got["prompt"], got["memory"], got["builtin"], got["skill_tokens"]) == (2 + 3, 15 + 20 + 1 + 100, 9_055, 180)
    assert sorted(got["servers"]) == ["a", "b", "c"] and sorted(got["skills"]) == ["s1", "s2", "s3"]
    none = logs.gather_config(spark, [], str(tmp_path / "no"), str(tmp_path / "no.json"), str(tmp_path / "no.json"))
    assert (none["prompt"], none["memory"], none["servers"]) == (0, 0, [])


def test_thresholds_and_framing_reach_the_analysis(read):
    m = read(*(x for k in range(6) for x in (ask("q" * 40), reply(1_000 + 200 * k, out=100))), name="fr")
    a = analyze.analyze(m, prompt=2_000, thresholds=state.Thresholds.of({"oversized_system": 500, "stale_read": -1}))
    assert {r.type: r.tokens for r in a.waste.collect()} == {"oversized_system": 1_500}
    each = a.framing.first().tokens_per_message
    b = {r.category: r for r in a.buckets.collect()}
    assert each == 45 and b["user"].tokens == 10 and b["user"].n_messages == 1
    assert a.current.count() == 0


def test_doctor_and_files(spark, tmp_path):
    home, own = tmp_path / "home", tmp_path / "own"
    first = {r.name: r.status for r in doctor.run_doctor(spark, str(home), str(own)).collect()}
    assert len(first) == 9 and (first["home folder"], first["settings"], first["sessions"], first["backups"]) == ("fail", "warn", "warn", "ok")
    (home / "projects" / "p").mkdir(parents=True)
    (home / "projects" / "p" / "s.jsonl").write_text(ask("a"))
    (home / "settings.json").write_text('{"hooks": {"Stop": [{"hooks": [{"command": "sparkloom status"}]}]}, "statusLine": {"command": "other"}}')
    (own / "calibration.json").write_text("{oops")
    (own / "history.jsonl").write_text("{}\n{}\n")
    checks = doctor.run_doctor(spark, str(home), str(own))
    now = {r.name: (r.status, r.detail) for r in checks.collect()}
    assert now["hook"] == ("ok", "installed") and now["status line"] == ("warn", "other") and now["calibration"][0] == "fail" and now["history"] == ("ok", "2 records") and now["sessions"] == ("ok", "1 sessions")
    assert R.worst_status(checks.withColumn("all", F.lit(1)), "all").first().status == "fail"
    at = str(tmp_path / "c.json")
    state.upsert_config(at, {"a": {"x": 1}, "b": 2})
    assert state.upsert_config(at, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 2} == json.loads((tmp_path / "c.json").read_text())
    backups = spark.createDataFrame([("f", f"f.{k:02d}") for k in range(13)] + [("g", "g.1")], "file string, name string")
    assert {r.name for r in state.surplus_backups(backups).collect()} == {"f.00", "f.01", "f.02"}


def test_texts_hand_on_their_hashes_in_parts():
    import numpy as np
    import pyarrow as pa

    from sparkloom.operators import lost

    texts = ["".join(map(chr, range(k, k + 40_000))) for k in range(100, 1000, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    out = list(lost._gram_batches([batch, batch.slice(0, 0)], (8, 1), ["id", "hs", "n"]))
    assert max(len(b.column(1).flatten()) for b in out) < lost.HASHES + 80_000
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(len(texts)))
    want = np.concatenate([lost._gram_hashes(texts[-1], g, True) for g in (8, 1)])
    assert out[-1].column(1)[-1].as_py() == want.tolist()


def test_rows_are_spread_by_their_number(spark):
    from sparkloom.sources.adapters import event_messages
    from sparkloom.sources.shared import spread

    rows = spark.range(1000, numPartitions=1).selectExpr("id % 100 AS k", "id")
    got = spread(rows, "k", task_rows=50)
    assert got.rdd.getNumPartitions() == 20 and got.count() == 1000
    assert spread(rows.limit(0), "k").count() == 0
    # a session's windows and groups keep the dealing of the table as read
    m = C.classify(event_messages(spark, "/root/testdata/sf0.1"))
    plan = m.groupBy("session_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 1 and "ENSURE_REQUIREMENTS" not in plan.split("Exchange hashpartitioning(user_id")[0]


def test_waste_is_sought_when_asked_for(read, monkeypatch):
    sought = []
    real = W.detect_waste
    monkeypatch.setattr(W, "detect_waste", lambda *a, **k: sought.append(1) or real(*a, **k))
    a = analyze.analyze(read(ask("hi"), reply(5000), ask("more")), prompt=3000, cache=True)
    assert a.state.count() == 1 and a.buckets.count() == 6 and not sought
    assert a.waste.count() == 1 and a.recommendations.count() > 0 and sought == [1]
