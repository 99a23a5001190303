"""Registered queries: contract of the entry module, and results against their SQL."""

import importlib

import duckdb
import pytest

from sparkloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["context_breakdown", "current_context_breakdown", "model_segments", "compaction_events", "message_framing", "stale_reads", "mcp_servers", "lost_file_reads", "session_diff", "trend_summary", "file_refs", "cutoff_trim", "content_survival", "calibration_parse", "calibration_compare", "jsonl_sessions", "analyze_current_context", "unused_results", "lost_tool_results", "inject_decision", "watch_feed", "tail_sessions", "incremental_analysis", "await_compactions", "session_cuts", "lost_content", "lost_agent_results", "project_configuration", "markdown_pages", "throttled_notes", "discovered_sessions", "trend_log", "timeline_in_blocks", "report_pages", "recommendations_all", "analyze_totals", "trend_csv_full", "short_survival", "bench_insights", "injection_text"]

ENDS = ["effective_window", "context_health", "bench_snapshots", "bench_snapshot_compare", "fix_prompts", "recommendations", "recommendations_all", "status_line", "analyze_totals", "injection_text", "report_pages"]


def test_entry_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    _equal(spark, con, name, SF)


@pytest.fixture(scope="module")
def cut_short(tmp_path_factory):
    """Events of which every other compacted session ends with its last compaction."""
    d = tmp_path_factory.mktemp("cut_short")
    duckdb.sql(f"""copy (with b as (select user_id, max((ts, event_id)) as last from '{SF}/events.parquet' where event_type = 'error' and cast(json_extract_string(props, '$.k') as int) < 5 group by user_id)
      select e.* from '{SF}/events.parquet' e left join b using (user_id) where coalesce((ts, event_id) <= last or user_id % 2 = 1, true)) to '{d}/events.parquet'""")
    return str(d)


@pytest.mark.parametrize("name", ENDS)
def test_sessions_that_end_with_a_compaction(spark, cut_short, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{cut_short}/events.parquet'")
    _equal(spark, con, name, cut_short)


def _equal(spark, con, name, d):
    df = catalog.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want
