"""Growing logs: the tail, the incremental state and the waiter against whole reads."""

import datetime
import io
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import analyze, classify as C, compaction as K
from sparkloom.sources import logs, tail
from sparkloom.streaming import live, waiting
from sparkloom.streaming.incremental import Incremental

from .test_engine import ask, boundary, call, line, reply, result


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_ranges_share_out_the_records(width, monkeypatch):
    monkeypatch.setattr(tail, "BACK", 5)
    monkeypatch.setattr(tail, "TOGETHER", 11)
    rng = random.Random(width)
    whole = b"".join(bytes(rng.choices(b"ab\xc3\xa9", k=rng.randrange(0, 30))) + b"\n" for _ in range(60)) + b"no end yet"
    got, sizes = [], sorted(rng.sample(range(len(whole)), 5)) + [len(whole)]
    before = {}
    for size in sizes:
        for _, start, end in tail.ranges(before, {"p/s.jsonl": size}, width):
            got += tail.records(io.BytesIO(whole[:size]), start, end)
        before = {"p/s.jsonl": size}
    lines = whole.split(b"\n")[:-1]
    assert [x for _, x in got] == lines and all(whole[at : at + len(x)] == x for at, x in got)


def test_small_logs_share_a_task():
    found = [(f"p/{i}", 0, 10) for i in range(7)] + [("p/x", 0, 100), ("p/y", 0, 100)]
    got = tail.bundles(found, 100, opening=20)
    assert [len(b) for b in got] == [3, 3, 1, 1, 1] and [r for b in got for r in b] == found


def test_a_shorter_log_is_read_again():
    assert tail.ranges({"p/s": 90, "p/t": 5}, {"p/s": 40, "p/t": 5, "p/u": 3}) == [("p/s", 0, 40), ("p/u", 0, 3)]


def test_tail_equals_one_batch_read(spark, tmp_path):
    base, out = tmp_path / "logs", tmp_path / "out"
    (base / "p").mkdir(parents=True)
    (base / "q").mkdir()
    texts = {"p/a": [ask(f"é {i}" * (i % 9)) for i in range(40)] + ["{broken", ""], "q/a": [reply(i) for i in range(30)], "q/b": [boundary(3)]}
    whole = {k: "".join(f"{x}\n" for x in v).encode() for k, v in texts.items()}
    for part in (0.3, 0.31, 0.9, 1):  # each step is a query of its own, as after a restart
        for name, raw in whole.items():
            if part > 0.3 or name == "p/a":
                (base / f"{name}.jsonl").write_bytes(raw[: int(len(raw) * part)])
        (base / "p" / "_try-1.jsonl").write_text(ask("being written") + "\n")
        found = live.run_once(tail.tail_messages(spark, base.as_uri(), width=100), out.as_uri())
    batch = logs.read_sessions(spark, str(base / "*" / "[a-z]*.jsonl"))
    columns = [c for c in batch.columns if c != "idx"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    order = {s: [r.line_no for r in found.filter(F.col("session_id") == s).orderBy("line_no").collect()] for s in texts}
    assert all(len(set(v)) == len(v) for v in order.values())


def _log(seed: int, n: int) -> list[str]:
    """A log in which calls are renamed later, results come late, compactions lie close together and the last
    human text changes kind."""
    rng, out = random.Random(seed), [line("user", "system-reminder first")]
    for i in range(n):
        kind = rng.randrange(9)
        out.append(
            [
                lambda: ask("plan_mode" if rng.random() < 0.3 else f"words {i}"),
                lambda: reply(rng.choice([0, 5_000, 90_000, 250_000, 40_000]), out=rng.choice([0, 9]), model=rng.choice(["m", "n[1m]", "<synthetic>"])),
                lambda: call("a/f.ts", f"t{rng.randrange(6)}", rng.choice(["Read", "Bash", "Edit"])),
                lambda: result(f"t{rng.randrange(6)}", "x" * rng.randrange(200)),
                lambda: result("never called", "y"),
                lambda: line("user", "memdir/ note" if rng.random() < 0.3 else "said"),
                lambda: line("user", "summary", isCompactSummary=True),
                lambda: boundary(5_000) if seed % 2 else reply(100),
                lambda: line("assistant", "plain", (5, 7, 1, 2), "m"),
            ][kind]()
        )
    return out


@pytest.mark.parametrize("fold_every", [2, 50])
def test_state_equals_the_whole_whatever_the_batches(spark, tmp_path, fold_every):
    (tmp_path / "p").mkdir()
    logs_of = {f"p/s{k}": _log(k, 45) for k in range(6)}
    for name, rows in logs_of.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    m = logs.read_sessions(spark, str(tmp_path / "p" / "*.jsonl")).cache()
    kept = Incremental((tmp_path / f"state{fold_every}").as_uri(), fold_every)
    rng = random.Random(fold_every)
    edges = sorted(rng.sample(range(1, 45), 4))
    rows = m.withColumn("line_no", F.col("idx"))
    for k, (low, high) in enumerate(zip([0, *edges], [*edges, 100], strict=True)):
        batch = rows.filter((F.col("idx") >= low) & (F.col("idx") < high)).drop("idx")
        kept.update(batch, k)
        if k in (1, 3):
            kept.update(batch, k)  # a batch that is run again replaces its first run
    state = kept.state(spark)
    c = C.classify(m)
    events = K.compaction_events(m)
    since = K.last_compaction(events)
    plain = lambda df: sorted((tuple(r) for r in df.select("session_id", "category", "tokens", "n_messages", "accuracy").collect()), key=str)
    assert plain(state.buckets) == plain(C.buckets(c))
    assert plain(state.current) == plain(C.buckets(K.current_context(c, events)))
    window = {r.session_id: r.effective for r in C.effective_window(m, since).collect()}
    limits = {r.session_id: (r.context_limit, r.signal) for r in analyze.analyze(m).limits.collect()}
    n_events = {r.session_id: r.n_compactions for r in since.collect()}
    for r in state.sessions.collect():
        assert (r.n, r.effective, (r.context_limit, r.signal), r.n_compactions) == (46, window[r.session_id], limits[r.session_id], n_events.get(r.session_id, 0))


def test_follow_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "logs" / "p").mkdir(parents=True)
    f, at = tmp_path / "logs" / "p" / "s.jsonl", (tmp_path / "c").as_uri()
    base = (tmp_path / "state").as_uri()
    rows = _log(3, 30)
    for n in (4, 11, 31):
        f.write_text("\n".join(rows[:n]) + "\n" + (rows[n][:20] if n < len(rows) else ""))
        Incremental(base).follow(tail.tail_messages(spark, (tmp_path / "logs").as_uri()), at).awaitTermination()
    whole = C.buckets(C.classify(logs.read_sessions(spark, str(f))))
    got = Incremental(base).state(spark).buckets
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def _wait(spark, tmp_path, batches, **kw):
    schema = "session_id string, at timestamp, request boolean, boundary boolean, tokens long"
    zero = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    for rows in batches:
        df = spark.createDataFrame([(s, zero + datetime.timedelta(seconds=t), kind == "ask", kind == "mark", tokens) for s, t, kind, tokens in rows], schema)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = live.run_once(waiting.await_compactions(src, **kw), (tmp_path / "out").as_uri())
    base = int(zero.timestamp() * 1000)
    return {(r.session_id, (r.began_ms - base) / 1000): (r.status, (r.ended_ms - base) / 1000, r.before_messages, r.after_messages, r.before_compactions, r.after_compactions, r.before_tokens, r.after_tokens) for r in out.collect()}


def test_waits_of_many_sessions(spark, tmp_path):
    batches = [
        [("a", 0, "", 90), ("a", 5, "ask", None), ("late", 1, "", 7), ("late", 2, "ask", None), ("none", 3, "ask", None), ("twice", 1, "", 1), ("twice", 2, "ask", None), ("twice", 3, "ask", None)],
        # the boundary, what settles after it, and what comes too late to count
        [("a", 8, "mark", None), ("a", 9, "", 20), ("a", 10, "", None), ("a", 11, "", 60), ("twice", 9, "mark", None)],
        [("a", 60, "ask", None), ("late", 903, "mark", None), ("other", 2000, "", 5)],
    ]
    assert _wait(spark, tmp_path, batches, by_event=True) == {
        ("a", 5): ("compacted", 10.5, 1, 4, 0, 1, 90, 20),
        ("none", 3): ("error", 3, 0, None, 0, None, 0, None),
        ("twice", 3): ("error", 3, 1, None, 0, None, 1, None),
        ("twice", 2): ("compacted", 11.5, 1, 2, 0, 1, 1, 1),
        ("late", 2): ("timeout", 902, 1, 1, 0, 0, 7, 7),
        ("a", 60): ("timeout", 960, 5, 5, 1, 1, 60, 60),
    }


def test_groups_do_not_grow_with_the_sessions(spark, tmp_path):
    n = 2500
    rows = spark.range(n).selectExpr("id", "explode(sequence(0, 3)) AS k").filter("k < 3 OR id % 2 = 0")
    rows = rows.selectExpr("CAST(id AS string) AS session_id", "timestamp_seconds(1704067200 + 10 * k) AS at", "k = 1 AS request", "k = 2 AND id % 3 = 0 AS boundary", "IF(k = 0, id + 1, NULL) AS tokens")
    rows.write.parquet(str(tmp_path / "in"))
    out = waiting.await_compactions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), timeout_ms=15_000, by_event=True)
    q = out.writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.schema(waiting.STATUS).json(str(tmp_path / "out")).collect()
    want = [(str(i), *(("compacted", 22_500) if i % 3 == 0 else ("timeout", 25_000)), 1, 2, i + 1, i + 1) for i in range(n)]
    assert sorted((r.session_id, r.status, r.ended_ms - 1704067200000, r.before_messages, r.after_messages, r.before_tokens, r.after_tokens) for r in got) == sorted(want)
    assert max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= waiting.BUCKETS < n


def test_sessions_that_share_a_group(spark, tmp_path):
    rng, batches, at = random.Random(5), [], 0
    for _ in range(3):
        batches.append([])
        for _ in range(60):
            at += rng.randrange(1, 60)
            batches[-1].append((f"s{rng.randrange(9)}", at, rng.choice(["", "", "ask", "mark"]), rng.choice([None, at])))
    kw = {"timeout_ms": 200_000, "settle_ms": 30_000, "by_event": True}
    alone = _wait(spark, tmp_path / "alone", batches, buckets=100_000, **kw)
    assert {s[0] for s in alone.values()} == {"compacted", "timeout", "error"}
    assert _wait(spark, tmp_path / "together", batches, buckets=1, **kw) == alone


def test_timers_of_the_clock(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, False, False, 3)], "session_id string, at timestamp, request boolean, boundary boolean, tokens long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = waiting.await_compactions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), timeout_ms=1)
    q = stream.writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
    try:
        for _ in range(30):  # processAllAvailable would wait for timers for ever
            time.sleep(1)
            if any(p["numInputRows"] for p in q.recentProgress):
                break
        rows.withColumn("request", F.lit(True)).write.mode("append").parquet(str(tmp_path / "in"))
        got = []
        for _ in range(30):
            time.sleep(1)
            if (tmp_path / "out").exists() and (got := spark.read.schema(waiting.STATUS).json(str(tmp_path / "out")).collect()):
                break
    finally:
        q.stop()
    assert [(r.session_id, r.status, r.after_messages) for r in got] == [("a", "timeout", 1)]


def test_records_of_a_log(spark, tmp_path):
    (tmp_path / "p").mkdir()
    lines = [json.dumps(json.loads(x) | {"timestamp": f"2024-01-01T00:00:0{i}Z"}) for i, x in enumerate((ask("a"), reply(500), boundary(9)))]
    (tmp_path / "p" / "s.jsonl").write_text("\n".join(lines) + "\n")
    rows = waiting.records(logs.read_sessions(spark, str(tmp_path / "p" / "s.jsonl"))).orderBy("at").collect()
    assert [(r.session_id, r.request, r.boundary, r.tokens) for r in rows] == [("p/s", False, False, None), ("p/s", False, False, 500), ("p/s", False, True, None)]
