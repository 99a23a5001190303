"""Settings, history, calibration and benchmark files, and the built-in tool dimension."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_bom
from .appends import ordered_lines

# Built-in tools and the tokens of their schemas.
BUILTIN_TOOLS = (
    ("Read", 250), ("Write", 280), ("Edit", 280), ("Bash", 250), ("Glob", 200), ("Grep", 250), ("WebFetch", 250),
    ("WebSearch", 230), ("Agent", 280), ("TodoRead", 200), ("TodoWrite", 230), ("NotebookEdit", 250),
    ("AskUserQuestion", 200), ("Skill", 230), ("TaskCreate", 230), ("TaskUpdate", 230), ("TaskGet", 200),
    ("TaskList", 200), ("TaskOutput", 200), ("TaskStop", 200), ("EnterPlanMode", 200), ("ExitPlanMode", 200),
    ("EnterWorktree", 230), ("ExitWorktree", 200), ("CronCreate", 250), ("CronDelete", 200), ("CronList", 200),
    ("RemoteTrigger", 230), ("ToolSearch", 230), ("Tool_30", 225), ("Tool_31", 225), ("Tool_32", 225), ("Tool_33", 225),
    ("Tool_34", 225), ("Tool_35", 225), ("Tool_36", 225), ("Tool_37", 225), ("Tool_38", 225), ("Tool_39", 225), ("Tool_40", 225),
)


def builtin_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, int(t)) for n, t in BUILTIN_TOOLS], "name string, tokens bigint")


@dataclass(frozen=True)
class Thresholds:
    """Limits of the waste detectors; a value that is no positive finite number keeps the default."""

    stale_read: float = 15
    oversized_system: float = 1500
    cache_overhead: float = 0.6
    resolution_lookback: float = 10
    oversized_prompt: float = 1500

    @classmethod
    def of(cls, given: dict | None) -> Thresholds:
        def good(v) -> bool:
            return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v > 0

        given = given if isinstance(given, dict) else {}
        return cls(**{f.name: given[f.name] for f in fields(cls) if good(given.get(f.name))})


@dataclass(frozen=True)
class Injection:
    """When a note is given: switched on, from a threshold in percent, with a gap between two."""

    enabled: bool = False
    threshold: float = 70
    min_gap_ms: int = 300_000

    @classmethod
    def of(cls, given: dict | None) -> Injection:
        given = given if isinstance(given, dict) else {}
        e, t, g = (given.get(f.name) for f in fields(cls))
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        base = cls()
        return cls(e if isinstance(e, bool) else base.enabled, t if number(t) and 0 < t <= 100 else base.threshold, g if number(g) and g >= 0 else base.min_gap_ms)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object; a missing or corrupt file is an empty one."""
    import json

    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).select(strip_bom(F.col("value"))).take(1)
        got = json.loads(rows[0][0]) if rows else {}
    except (AnalysisException, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def upsert_config(path: str, changes: dict) -> dict:
    """Write ``changes`` into the JSON object of a local file; other keys, nested ones too, stay."""
    import json
    import os

    def merged(old, new):
        return {**old, **{k: merged(old.get(k), v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}}

    try:
        with open(path, encoding="utf-8-sig") as f:
            old = json.load(f)
    except (FileNotFoundError, ValueError):
        old = {}
    out = merged(old if isinstance(old, dict) else {}, changes)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)
    return out


def surplus_backups(backups: DataFrame, keep: int = 10) -> DataFrame:
    """Rows (file, name) of backups that can go: all but the ``keep`` newest, by name, of each file."""
    newest = Window.partitionBy("file").orderBy(F.desc("name"))
    return backups.withColumn("r", F.row_number().over(newest)).filter(F.col("r") > keep).select("file", "name")


_RECORD = "sessionId string, projectName string, timestamp string, totalTokens bigint, percentUsed double, messageCount bigint, compactionCount bigint, health string, topCategory string, topCategoryTokens bigint, contextLimit bigint"


def read_trend_log(spark: SparkSession, path: str) -> DataFrame:
    """Trend records of text files with their places; lines that are no record are skipped."""
    return trend_records(ordered_lines(spark, path))


def trend_records(lines: DataFrame) -> DataFrame:
    """Trend records of (line, value), as of an ``AppendLog``; ``line`` orders them."""
    rows = lines.select("line", F.from_json("value", _RECORD).alias("j"), F.expr("schema_of_variant(try_variant_get(try_parse_json(value), '$.sessionId', 'variant')) = 'STRING'").alias("ok")).filter("coalesce(ok, false)")
    return rows.select(F.col("j.sessionId").alias("session_id"), F.col("j.timestamp").alias("ts"), "line", F.col("j.projectName").alias("project"), F.col("j.percentUsed").alias("percent_used"), F.col("j.topCategory").alias("top_category"), F.col("j.totalTokens").alias("total_tokens"), F.col("j.messageCount").alias("message_count"), F.col("j.compactionCount").alias("compaction_count"), F.col("j.contextLimit").alias("context_limit"))


def read_json_file(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One JSON document as one row; a missing file, bad JSON or an absent required field raises."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    absent = set(required) - set(df.columns)
    if absent:
        raise ValueError(f"{path} lacks {sorted(absent)}")
    return df
