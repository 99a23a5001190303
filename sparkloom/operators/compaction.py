"""Compactions, model history and the overhead that can be derived from usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.text import CHARS_PER_TOKEN_SUMMARY, js_len, js_round
from .classify import in_order, so_far, by_session
from .tokens import content_tokens, effective_input

EVENT_COLUMNS = ("session_id", "before_idx", "after_idx", "tokens_before", "tokens_after", "tokens_dropped", "summary_idx", "summary_tokens", "detection")


def marker_events(messages: DataFrame) -> DataFrame:
    """Compactions by boundary rows; the summary is sought in the next four rows, the first
    assistant call in the next nine."""
    summary = F.when(F.coalesce(F.col("is_compact_summary"), F.lit(False)), F.struct("idx", F.ceil(js_len(F.coalesce("content_str", F.to_json("blocks"))) / F.lit(CHARS_PER_TOKEN_SUMMARY)).cast("bigint").alias("tokens")))
    call = F.when((F.col("type") == "assistant") & F.col("usage").isNotNull(), F.struct("idx", effective_input().alias("eff")))
    m = messages.select("session_id", "idx", "type", "subtype", "pre_tokens", summary.alias("s"), call.alias("c"))
    m = m.withColumns({"s": F.first("s", ignorenulls=True).over(in_order().rowsBetween(1, 4)), "c": F.first("c", ignorenulls=True).over(in_order().rowsBetween(1, 9))})
    before, after = F.coalesce("pre_tokens", F.lit(0)), F.coalesce("c.eff", F.lit(0))
    return m.filter((F.col("type") == "system") & (F.col("subtype") == "compact_boundary")).select(
        "session_id",
        F.col("idx").alias("before_idx"),
        F.coalesce("c.idx", F.col("idx") + 1).alias("after_idx"),
        before.alias("tokens_before"),
        after.alias("tokens_after"),
        (before - after).alias("tokens_dropped"),
        F.col("s.idx").alias("summary_idx"),
        F.col("s.tokens").alias("summary_tokens"),
        F.lit("marker").alias("detection"),
    )


def heuristic_events(messages: DataFrame, drop: int = S.COMPACTION_DROP) -> DataFrame:
    """Compactions by a fall of more than ``drop`` input tokens between assistant calls."""
    calls = messages.filter((F.col("type") == "assistant") & F.col("usage").isNotNull()).select("session_id", "idx", effective_input().alias("eff"))
    calls = calls.withColumns({"prev_idx": F.lag("idx").over(in_order()), "prev": F.lag("eff").over(in_order())})
    return calls.filter(F.col("prev") - F.col("eff") > drop).select(
        "session_id",
        F.col("prev_idx").alias("before_idx"),
        F.col("idx").alias("after_idx"),
        F.col("prev").alias("tokens_before"),
        F.col("eff").alias("tokens_after"),
        (F.col("prev") - F.col("eff")).alias("tokens_dropped"),
        F.lit(None).cast("bigint").alias("summary_idx"),
        F.lit(None).cast("bigint").alias("summary_tokens"),
        F.lit("heuristic").alias("detection"),
    )


def compaction_events(messages: DataFrame, drop: int = S.COMPACTION_DROP) -> DataFrame:
    """Marker events; sessions without any fall back to the heuristic."""
    marked = marker_events(messages)
    rest = heuristic_events(messages, drop).join(marked.select("session_id").distinct(), "session_id", "left_anti")
    return marked.unionByName(rest.select(*EVENT_COLUMNS))


def last_compaction(events: DataFrame) -> DataFrame:
    """Rows (session_id, start_idx, n_compactions) of compacted sessions."""
    return events.groupBy("session_id").agg(F.max_by("after_idx", "before_idx").alias("start_idx"), F.count(F.lit(1)).alias("n_compactions"))


def model_segments(messages: DataFrame) -> DataFrame:
    """Runs of one model among real assistant messages, with their sums."""
    real = messages.filter((F.col("type") == "assistant") & F.col("model").isNotNull() & (F.col("model") != S.SYNTHETIC))
    u = F.col("usage")
    rows = real.select("session_id", "idx", "model", "ts", *(F.coalesce(u[f], F.lit(0)).alias(f) for f in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")))
    starts = F.when(F.lag("model").over(in_order()).eqNullSafe(F.col("model")), 0).otherwise(1)
    rows = rows.withColumn("starts", starts)
    rows = rows.withColumn("segment", F.sum("starts").over(so_far()))
    return rows.groupBy("session_id", "segment").agg(
        F.min("model").alias("model"),
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.count(F.lit(1)).alias("n_messages"),
        *(F.sum(f).alias(f) for f in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")),
    )


def model_history(segments: DataFrame) -> DataFrame:
    """Rows (session_id, current_model, n_switches, n_models, models by first appearance)."""
    firsts = segments.groupBy("session_id", "model").agg(F.min("segment").alias("at"))
    named = firsts.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_models"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]), ",").alias("models"))
    last = segments.groupBy("session_id").agg(F.max_by("model", "segment").alias("current_model"), (F.count(F.lit(1)) - 1).alias("n_switches"))
    return last.join(named, "session_id")


def internal_prompt(messages: DataFrame, prompt: int = 0, builtin: int = S.BUILTIN_SCHEMA_TOKENS, memory: int = 0, skill_tokens: int = 0, costs: DataFrame | None = None) -> DataFrame:
    """Rows (session_id, first_input, tokens): input of the first call less all that is known;
    tokens is null outside 1,000 to 15,000. ``costs`` gives what is known of each session (``session_costs``)."""
    call = (F.col("type") == "assistant") & (F.col("usage.input_tokens") > 0)
    user = (F.col("type") == "user") & (F.col("role") == "user")
    exact = F.lit(False)
    one = messages.groupBy("session_id").agg(
        F.min_by(effective_input(), F.when(call, F.col("idx"))).alias("first_input"),
        F.min_by(F.when(~exact, content_tokens()), F.when(user, F.col("idx"))).alias("first_user"),
    )
    known = F.lit(prompt + builtin + memory + (skill_tokens or S.DEFAULT_SKILL_TOKENS)) + F.coalesce("first_user", F.lit(0))
    if costs is not None:
        one = one.join(costs, "session_id")
        skilled = F.when(F.col("skill_tokens") > 0, F.col("skill_tokens")).otherwise(S.DEFAULT_SKILL_TOKENS)
        known = F.col("prompt") + F.col("builtin") + F.col("memory") + skilled + F.coalesce("first_user", F.lit(0))
    left = F.col("first_input") - known
    return one.select("session_id", "first_input", F.when(left.between(1000, 15000), left).alias("tokens"))


def framing(classified: DataFrame, since: DataFrame | None = None, max_samples: int = 20) -> DataFrame:
    """Rows (session_id, tokens_per_message, total_tokens, n_samples): what each message costs
    beyond its content, as the upper median over consecutive calls."""
    c = classified.select("session_id", "idx", "type", "tokens", effective_input().alias("eff"), F.sum("tokens").over(so_far()).alias("upto"))
    sizes = classified.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    calls = c.filter((F.col("type") == "assistant") & (F.col("eff") > 0))
    if since is not None:
        calls = calls.join(since.select("session_id", "start_idx"), "session_id", "left").filter(F.col("idx") >= F.coalesce("start_idx", F.lit(0)))
    down = by_session().orderBy(F.desc("idx"))
    pairs = calls.withColumns({"next_idx": F.lead("idx").over(in_order()), "next_eff": F.lead("eff").over(in_order()), "next_before": F.lead(F.col("upto") - F.col("tokens")).over(in_order()), "back": F.row_number().over(down), "n_calls": F.count(F.lit(1)).over(by_session())})
    pairs = pairs.filter((F.col("n_calls") >= 3) & F.col("next_idx").isNotNull() & (F.col("back") <= max_samples + 1) & (F.col("next_eff") > F.col("eff")))
    expected = F.col("next_before") - (F.col("upto") - F.col("tokens"))
    sample = (F.col("next_eff") - F.col("eff") - expected) / (F.col("next_idx") - F.col("idx"))
    pairs = pairs.withColumn("x", sample).filter(F.col("x").between(0, 50))
    lists = pairs.groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).filter(F.size("xs") >= 3)
    median = F.element_at("xs", (F.floor(F.size("xs") / 2) + 1).cast("int"))
    out = lists.join(sizes, "session_id").select("session_id", js_round(median).alias("tokens_per_message"), F.size("xs").cast("bigint").alias("n_samples"), "n")
    return out.select("session_id", "tokens_per_message", (F.col("tokens_per_message") * F.col("n")).alias("total_tokens"), "n_samples")


def slice_from(rows: DataFrame, since: DataFrame) -> DataFrame:
    """Rows from the session's start_idx on, with rel_idx counted from there."""
    start = F.coalesce("start_idx", F.lit(0))
    j = rows.join(since.select("session_id", "start_idx"), "session_id", "left").filter(F.col("idx") >= start)
    return j.withColumn("rel_idx", F.col("idx") - start).drop("start_idx")


def current_context(classified: DataFrame, events: DataFrame) -> DataFrame:
    """Classified rows of compacted sessions from the last compaction's first call on."""
    return classified.join(last_compaction(events).select("session_id", "start_idx"), "session_id").filter("idx >= start_idx")


def projection(total, limit, n_messages):
    """Messages left until the automatic compaction; null where it cannot be told."""
    each = total / n_messages
    left = F.floor((limit * F.lit(S.COMPACTION_SHARE) - total) / each)
    return F.when(total >= limit * F.lit(S.COMPACTION_SHARE), F.lit(0)).when((n_messages > 0) & (each > 0), left).cast("bigint")


def timeline_sample(classified: DataFrame, events: DataFrame, show_all: int = 60, edge: int = 10, middle: int = 40) -> DataFrame:
    """Rows to show: all of a short session, else both ends, evenly spaced rows and compactions."""
    n = F.count(F.lit(1)).over(by_session())
    step = F.greatest(F.lit(1), F.floor((n - 2 * edge) / middle)).cast("bigint")
    inner = (F.col("idx") >= edge) & (F.col("idx") < n - edge)
    spaced = inner & ((F.col("idx") - edge) % step == 0) & (F.floor((F.col("idx") - edge) / step) < middle)
    at = events.select("session_id", F.col("before_idx").alias("idx"), F.lit(True).alias("compacts")).distinct()
    rows = classified.join(at, ["session_id", "idx"], "left")
    keep = (n <= show_all) | (F.col("idx") < edge) | (F.col("idx") >= n - edge) | spaced | F.coalesce("compacts", F.lit(False))
    return rows.withColumn("_keep", keep).filter("_keep").drop("_keep", "compacts")
