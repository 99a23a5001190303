"""Waiting for the compaction of any number of sessions, with state and timers kept by Spark.

A request takes a snapshot of its session and starts a timer. The session's next compaction
boundary replaces it by a short one, so that what is written right after the boundary is
still counted; then the session is compared with its snapshot. A session whose boundary does not come in
time ends as timed out, and a request for a session without any record as an error. Nothing
polls, and a restarted query goes on waiting.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.tokens import effective_input
from ..sources.shared import ship

TIMEOUT_MS, SETTLE_MS = 900_000, 2_500
STATUS = "session_id string, status string, message string, began_ms bigint, ended_ms bigint, before_messages bigint, after_messages bigint, before_compactions bigint, after_compactions bigint, before_tokens bigint, after_tokens bigint"
#: Groups that sessions are dealt over by hash. Spark calls a function once a group and batch, which costs
#: far more than the rows it hands over, so a group holds many sessions.
BUCKETS = 2048
#: What each session of a bucket holds so far, and the request that waits, if any.
_STATE = "session_id array<string>, messages array<bigint>, compactions array<bigint>, tokens array<bigint>, began array<bigint>, found array<bigint>, before_messages array<bigint>, before_compactions array<bigint>, before_tokens array<bigint>"
_NO_WAIT = (None,) * 5


def records(messages: DataFrame, at: str = "ts") -> DataFrame:
    """What a waiter needs of (streaming) message rows: (session_id, at, request, boundary, tokens)."""
    boundary = F.coalesce((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"), F.lit(False))
    tokens = F.when((F.col("type") == "assistant") & (effective_input() > 0), effective_input())
    return messages.select(F.col("session_id").cast("string").alias("session_id"), F.to_timestamp(at).alias("at"), F.lit(False).alias("request"), boundary.alias("boundary"), tokens.alias("tokens"))


def requests(sessions: DataFrame, at: str = "at") -> DataFrame:
    """Requests in the form of ``records``, to be added to them."""
    return sessions.select(F.col("session_id").cast("string").alias("session_id"), F.to_timestamp(at).alias("at"), F.lit(True).alias("request"), F.lit(False).alias("boundary"), F.lit(None).cast("bigint").alias("tokens"))


def _step(timeout_ms: int, settle_ms: int, by_event: bool):
    """What happens to the sessions of a bucket when rows arrive or time is up: a function for ``applyInPandasWithState``."""

    def deadline(wait) -> int:
        began, found = wait[:2]
        return began + timeout_ms if found is None else found + settle_ms

    def end(session, wait, counts) -> tuple:
        began, found, *before = wait
        status = ("timeout", "no boundary was written") if found is None else ("compacted", None)
        return (session, *status, began, deadline(wait), *(x for pair in zip(before, counts, strict=True) for x in pair))

    def step(key, frames, state) -> Iterator:
        import pandas as pd

        now = state.getCurrentProcessingTimeMs()
        counts, waits = {}, {}
        for session, *held in zip(*state.get, strict=True) if state.exists else ():
            counts[session] = tuple(held[:3])
            if held[3] is not None:
                waits[session] = tuple(held[3:])
        done = []
        for session, at, request, boundary, tokens in () if state.hasTimedOut else _in_order(pd.concat(frames), None if by_event else now):
            wait, sums = waits.get(session), counts.get(session, (0, 0, 0))
            if wait and at >= deadline(wait):
                done.append(end(session, waits.pop(session), sums))
                wait = None
            if request:
                if wait or not sums[0]:
                    why = "a request waits already" if wait else "no such session"
                    done.append((session, "error", why, at, at, *(x for c in sums for x in (c, None))))
                else:
                    waits[session] = (at, None, *sums)
                continue
            counts[session] = (sums[0] + 1, sums[1] + bool(boundary), sums[2] if tokens is None else tokens)
            if boundary and wait and wait[1] is None:
                waits[session] = (wait[0], at, *wait[2:])
        reached = state.getCurrentWatermarkMs() if by_event else now
        for session in [s for s, wait in waits.items() if deadline(wait) <= reached]:
            done.append(end(session, waits.pop(session), counts[session]))
        if counts:
            state.update(tuple(map(list, zip(*((s, *c, *waits.get(s, _NO_WAIT)) for s, c in counts.items()), strict=True))))
        if waits and by_event:  # time is up once the watermark has reached the deadline, not only passed it
            state.setTimeoutTimestamp(max(min(map(deadline, waits.values())) - 1, 1))
        elif waits:
            state.setTimeoutDuration(min(map(deadline, waits.values())) - now)
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in STATUS.split(", ")], dtype="object")

    return step


def _in_order(rows, now: int | None) -> Iterator[tuple]:
    """Rows (session_id, ms, request, boundary, tokens) in time, which is ``now`` if that is given."""
    if now is not None:
        rows["ms"] = now
    # a request counts the records of its own instant as before it
    rows = rows.sort_values(["ms", "request"], kind="stable")
    tokens = (int(x) if known else None for x, known in zip(rows["tokens"], rows["tokens"].notna(), strict=True))
    return zip(rows["session_id"].tolist(), rows["ms"].tolist(), rows["request"].tolist(), rows["boundary"].tolist(), tokens, strict=True)


def await_compactions(stream: DataFrame, timeout_ms: int = TIMEOUT_MS, settle_ms: int = SETTLE_MS, by_event: bool = False, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """One row for each request in a stream of ``records`` and ``requests``, when it ends.

    Time is the clock's, or that of the records (``by_event``; records later than ``late`` are dropped).
    By the clock a timer may always fire, so such a query runs until it is stopped and has no end
    of what is available. The state lies in RocksDB, in ``buckets`` values: a restarted query keeps their number,
    and a batch reads and writes those that its rows or due timers fall into."""
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = stream.withWatermark("at", late) if by_event else stream
    session = F.col("session_id").cast("string")
    dealt = timed.select(F.pmod(F.hash(session), F.lit(buckets)).alias("bucket"), "at", session.alias("session_id"), F.unix_millis("at").alias("ms"), "request", "boundary", "tokens")
    timeout = GroupStateTimeout.EventTimeTimeout if by_event else GroupStateTimeout.ProcessingTimeTimeout
    return dealt.groupBy("bucket").applyInPandasWithState(_step(timeout_ms, settle_ms, by_event), STATUS, _STATE, "append", timeout)
