"""One call that runs the whole analysis of all sessions of a message table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.text import duration_seconds
from ..sources.shared import cut
from ..sources.state import BUILTIN_TOOLS, Thresholds
from . import advice, classify as C, compaction as K, waste as W


@dataclass
class Analysis:
    classified: DataFrame
    events: DataFrame
    since: DataFrame
    buckets: DataFrame
    current: DataFrame
    window: DataFrame
    limits: DataFrame
    segments: DataFrame
    state: DataFrame
    derived: DataFrame
    framing: DataFrame
    tools: DataFrame
    servers: DataFrame | None
    durations: DataFrame
    find_waste: Callable[[], DataFrame]
    find_consumers: Callable[[DataFrame], DataFrame]
    advise: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]

    # waste costs more than all else, so it is sought (and written) by those who ask for it or what follows from it
    @cached_property
    def waste(self) -> DataFrame:
        return self.find_waste()

    @cached_property
    def focus(self) -> DataFrame:
        return advice.compact_focus(self.waste)

    @cached_property
    def consumers(self) -> DataFrame:
        return self.find_consumers(self.waste)

    @cached_property
    def recommendations(self) -> DataFrame:
        return self.advise(self.waste, self.focus, self.consumers)


def durations(messages: DataFrame) -> DataFrame:
    """Rows (session_id, duration_seconds): from the first message's time to the last one's, null unless positive."""
    ends = messages.groupBy("session_id").agg(F.min_by("ts", "idx").alias("first"), F.max_by("ts", "idx").alias("last"))
    return ends.select("session_id", duration_seconds(F.col("first"), F.col("last")).alias("duration_seconds"))


def analyze(messages: DataFrame, prompt: int = 0, memory: int = 0, config: dict | None = None, thresholds: Thresholds | None = None, cache: bool = False, until: int | None = None, configs: DataFrame | None = None) -> Analysis:
    """All intermediate tables, lazily; ``cache`` writes the classified rows once for all of them, and the waste when it is first asked for.

    ``config`` is what ``sources.logs.gather_config`` returns; ``prompt`` and ``memory`` stand in for it.
    ``until`` takes the first rows of each session; without it a trailing turn in which the analyser itself
    was run is left out. ``buckets`` are those of the whole sessions with fixed costs, ``current`` those
    from the last compaction on, which also get what each message costs beyond its content.

    ``configs`` (rows of ``sources.configs.project_configs``) gives each session the fixed costs of its project, the
    part of session_id before the slash; waste and advice on the prompt's size still take ``prompt``."""
    messages = messages.filter(F.col("idx") < until) if until is not None else C.without_own_turn(messages)
    known = {"prompt": prompt, "memory": memory, "builtin": S.BUILTIN_SCHEMA_TOKENS, "mcp": 0, "skill_tokens": 0} | (config or {})
    t = thresholds or Thresholds()
    classified = C.classify(messages)
    if cache:
        classified = messages = cut(classified)
    events = K.compaction_events(messages)
    since = K.last_compaction(events)
    segments = K.model_segments(messages)
    limits = C.context_limits(messages, K.model_history(segments).select("session_id", "current_model"))
    window = C.effective_window(messages, since)
    costs = C.session_costs(classified, configs, F.split(F.col("session_id"), "/")[0], known["builtin"]) if configs is not None else None
    derived = K.internal_prompt(messages, known["prompt"], known["builtin"], known["memory"], known["skill_tokens"], costs).filter("tokens IS NOT NULL").select("session_id", "tokens")
    framing = K.framing(classified, since)
    overhead = C.config_overhead(classified, known["prompt"], known["builtin"], known["mcp"], known["memory"], derived) if costs is None else C.cost_rows(costs, derived)
    each = framing.select("session_id", "tokens_per_message")
    live = overhead.join(since.select("session_id"), "session_id", "left_semi")

    def find_waste() -> DataFrame:
        w = W.detect_waste(classified, messages, since, known["prompt"], stale_age=t.stale_read, oversized=t.oversized_system, cache=t.cache_overhead, lookback=int(t.resolution_lookback))
        return cut(w) if cache else w

    whole = C.buckets(classified, overhead)
    current = C.buckets(K.current_context(classified, events), live, each)
    content = [b.groupBy("session_id").agg(F.sum("tokens").alias("content")) for b in (current, whole.join(since, "session_id", "left_anti"))]
    state = advice.session_state(classified, window, limits, since, content[0].unionByName(content[1]))
    servers = tuple(known.get("servers", ()))
    share = whole.filter("category = 'tools'").select("session_id", F.col("percentage").alias("tool_percentage"))
    return Analysis(
        classified,
        events,
        since,
        whole,
        current,
        window,
        limits,
        segments,
        state,
        derived,
        framing,
        advice.tool_breakdown(classified, tuple(n for n, _ in BUILTIN_TOOLS) + servers),
        advice.mcp_usage(classified, servers) if servers else None,
        durations(messages),
        find_waste,
        lambda waste: advice.top_consumers(K.slice_from(classified, since), waste, events, derived, known["prompt"], known["builtin"] + known["mcp"], known["memory"]),
        lambda waste, focus, consumers: advice.recommendations(state, waste, focus, since, share, classified, servers, known["prompt"], consumers),
    )
