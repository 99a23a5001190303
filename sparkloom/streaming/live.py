"""Live sessions: compactions as they happen and throttled notes.

State is kept by Spark for each session, so a restarted query goes on where it stopped. The
records come from ``sources.tail``; ``incremental`` keeps the analysis, ``waiting`` waits.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def boundaries(messages: DataFrame) -> DataFrame:
    """The compaction boundaries of a (streaming) message table."""
    return messages.filter((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"))


def boundary_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw log lines that are boundary records; a substring test goes before the parse."""
    near = lines.filter(F.col(column).contains("compact_boundary"))
    return near.filter((F.get_json_object(column, "$.type") == "system") & (F.get_json_object(column, "$.subtype") == "compact_boundary"))


def new_compactions(stream: DataFrame) -> DataFrame:
    """Rows (session_id, known, now) whenever a session's number of boundaries grows."""

    def step(key, frames, state) -> Iterator:
        import pandas as pd

        before = state.get[0] if state.exists else 0
        now = before + sum(len(f) for f in frames)
        state.update((now,))
        if now > before:
            yield pd.DataFrame({"session_id": [str(key[0])], "known": [before], "now": [now]})

    keyed = boundaries(stream).select(F.col("session_id").cast("string").alias("session_id"), "idx")
    return keyed.groupBy("session_id").applyInPandasWithState(step, "session_id string, known long, now long", "n long", "append", GroupStateTimeout.NoTimeout)


def throttled(turns: DataFrame, threshold: float, min_gap_ms: int) -> DataFrame:
    """Turns (session_id, ts_ms, percentage) that get a note: over the threshold, and the gap
    since the session's last note at least ``min_gap_ms``."""

    def step(key, frames, state) -> Iterator:
        import pandas as pd

        last = state.get[0] if state.exists else None
        out = []
        rows = sorted(r for f in frames for r in zip(f["ts_ms"], f["percentage"], strict=True))
        for ts, pct in rows:
            if pct >= threshold and (last is None or ts - last >= min_gap_ms):
                out.append(int(ts))
                last = int(ts)
        if last is not None:
            state.update((last,))
        if out:
            yield pd.DataFrame({"session_id": [str(key[0])] * len(out), "ts_ms": out})

    keyed = turns.select(F.col("session_id").cast("string").alias("session_id"), "ts_ms", "percentage")
    return keyed.groupBy("session_id").applyInPandasWithState(step, "session_id string, ts_ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, to: str) -> DataFrame:
    """Drain what is there into JSON lines below ``to``, and read them back."""
    spark = stream.sparkSession
    q = stream.writeStream.format("json").option("checkpointLocation", f"{to}/state").outputMode("append").trigger(availableNow=True).start(f"{to}/feed")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).json(f"{to}/feed")
