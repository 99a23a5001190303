"""Message rows from the star-schema tables, for the registered queries.

The tables hold no session logs, so conversations and events are read as such: a
conversation turn is a text message; an event is a tool call, a tool result, a text or
a compaction boundary, with usage figures derived from its value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import BLOCK, MESSAGE_COLUMNS, USAGE
from .shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _canonical(df: DataFrame) -> DataFrame:
    """Fill the message columns that ``df`` lacks with nulls."""
    have = set(df.columns)
    return df.select("session_id", *(F.col(c).cast(t) if c in have else F.lit(None).cast(t).alias(c) for c, t in MESSAGE_COLUMNS.items()))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as sessions of text messages."""
    turns = table(spark, sf_dir, "conversations")
    return _canonical(
        turns.selectExpr(
            "conv_id AS session_id",
            "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS idx",
            "role AS type",
            "role",
            "'string' AS content_kind",
            "text AS content_str",
        )
    )


def _block(**fields: str) -> str:
    """SQL of an array of one block with the given fields, all others null."""
    names = [x.split(":")[0] for x in ("type", "text", "thinking", "signature", "name", "input_json", "id", "tool_use_id", "is_error", "content_kind", "content_str", "sub")]
    parts = ", ".join(f"{fields.get(n, 'NULL')} AS {n}" for n in names)
    return f"CAST(array(struct({parts})) AS array<{BLOCK}>)"


def event_messages(spark: SparkSession, sf_dir: str, mcp: bool = False, markers: bool = True, paths: str = "concat('src/f', k % 10, '.ts')", cumulative: bool = False, summaries: bool = False) -> DataFrame:
    """``events`` as sessions of tool use, one for each user.

    ``mcp`` names the tools after servers, ``markers`` turns some errors into compaction
    boundaries, ``paths`` is the SQL of the file that a call touches, and ``cumulative``
    replaces the usage by figures that grow with the messages; ``summaries`` marks every
    click whose key is a multiple of four as the summary of a compaction.
    """
    ev = spread(table(spark, sf_dir, "events"), "user_id")
    rows = ev.selectExpr(
        "user_id",
        "event_id",
        "event_type",
        "ts",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CAST(round(value * 100) AS BIGINT) * 10 AS eff",
        "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx",
    )
    rows = rows.selectExpr(
        "*",
        "last_value(CASE WHEN event_type IN ('view', 'purchase') THEN concat('u', event_id) END) IGNORE NULLS"
        " OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call_id",
        "event_type = 'error' AND k < 5 AND " + ("true" if markers else "false") + " AS boundary",
        "CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN 'assistant' ELSE 'user' END AS who",
    )
    read, edit = ("concat('mcp__s', k % 4, '__t')",) * 2 if mcp else ("'Read'", "'Edit'")
    call = lambda name: _block(type="'tool_use'", name=name, id="concat('u', event_id)", input_json=f"concat('{{\"file_path\":\"', {paths}, '\"}}')")
    usage = "named_struct('input_tokens', eff - (eff * k) div 100 - (eff - (eff * k) div 100) div 4, 'output_tokens', CAST(20 + k AS BIGINT), 'cache_creation_input_tokens', (eff - (eff * k) div 100) div 4, 'cache_read_input_tokens', (eff * k) div 100)"
    if cumulative:
        rows = rows.selectExpr("*", "coalesce(sum(20 + k + k % 40) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before")
        usage = "named_struct('input_tokens', 12000L + before, 'output_tokens', CAST(20 + k AS BIGINT), 'cache_creation_input_tokens', 0L, 'cache_read_input_tokens', 0L)"
    return _canonical(
        rows.selectExpr(
            "user_id AS session_id",
            "idx",
            "CASE WHEN boundary THEN 'system' ELSE who END AS type",
            "CASE WHEN boundary THEN 'compact_boundary' END AS subtype",
            "CASE WHEN NOT boundary THEN who END AS role",
            "CASE WHEN who = 'assistant' THEN CASE WHEN k % 10 = 9 THEN '<synthetic>' ELSE element_at(array('model-a', 'model-b', 'model-c[1m]'), k % 3 + 1) END END AS model",
            "CASE WHEN boundary THEN 'none' WHEN event_type = 'click' THEN 'string' ELSE 'array' END AS content_kind",
            "CASE WHEN event_type = 'click' THEN concat('see f', k % 20, '.ts', CASE WHEN k % 8 = 0 THEN ' after edit' ELSE '' END) END AS content_str",
            f"CASE WHEN boundary OR event_type = 'click' THEN NULL WHEN event_type = 'view' THEN {call(read)} WHEN event_type = 'purchase' THEN {call(edit)}"
            f" WHEN event_type = 'signup' THEN {_block(type=chr(39) + 'text' + chr(39), text="CASE WHEN k % 3 = 0 THEN repeat('signed up and done, ', 3) ELSE 'signup' END")}"
            f" ELSE {_block(type=chr(39) + 'tool_result' + chr(39), tool_use_id='call_id', content_kind=chr(39) + 'string' + chr(39), content_str='repeat(' + chr(39) + 'x' + chr(39) + ', 10 * k)')} END AS blocks",
            f"CASE WHEN who = 'assistant' THEN CAST({usage} AS {USAGE}) END AS usage",
            "CAST(ts AS STRING) AS ts",
            "CASE WHEN boundary THEN eff END AS pre_tokens",
            f"event_type = 'click' AND k % 4 = 0 AND {str(summaries).lower()} AS is_compact_summary",
        )
    )
