"""Categories of messages and what a context window holds.

All operators work on every session at once; windows are partitioned by session and
ordered by idx, so one exchange on session_id serves a whole plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from .tokens import effective_input, message_text, with_tokens


def by_session():
    """The rows of one session."""
    return Window.partitionBy("session_id")


def in_order():
    return by_session().orderBy("idx")


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def has_block(kind: str) -> Column:
    return F.coalesce(F.exists("blocks", lambda b: b["type"] == kind), F.lit(False))


def first_block(kind: str) -> Column:
    return F.get(F.filter("blocks", lambda b: b["type"] == kind), F.lit(0))


def _any_of(text: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(m) for m in markers))


def has_markers(markers, thinking: bool) -> Column:
    """True where a message's text holds one of the markers."""
    if thinking:
        text = message_text()
    else:
        parts = F.transform("blocks", lambda b: F.concat_ws(" ", b["text"], b["content_str"]))
        text = F.coalesce(F.when(F.col("content_kind") == "string", F.col("content_str")).otherwise(F.array_join(parts, " ")), F.lit(""))
    return F.coalesce(_any_of(text, markers), F.lit(False))


def tool_uses(messages: DataFrame) -> DataFrame:
    """Rows of tool calls: session_id, idx, pos, id, name, path, input_json."""
    calls = messages.select("session_id", "idx", "type", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 'tool_use'")
    path = F.coalesce(F.get_json_object("b.input_json", "$.file_path"), F.get_json_object("b.input_json", "$.path"))
    return calls.select("session_id", "idx", "type", "pos", F.col("b.id").alias("id"), F.col("b.name").alias("name"), path.alias("path"), F.col("b.input_json").alias("input_json"))


def tool_names(messages: DataFrame) -> DataFrame:
    """Rows (session_id, id, name): the last tool name for each call id."""
    calls = tool_uses(messages).filter("id <> '' AND name <> ''")
    return calls.groupBy("session_id", "id").agg(F.max_by("name", F.struct("idx", "pos")).alias("name"))


def last_human_text(messages: DataFrame) -> DataFrame:
    """Rows (session_id, last_human): the last user message that is no tool result."""
    human = (F.col("type") == "user") & (F.col("role") == "user") & ~has_block("tool_result")
    return messages.groupBy("session_id").agg(F.max(F.when(human, F.col("idx"))).alias("last_human"))


def row_marks(messages: DataFrame, state_markers=S.STATE_MARKERS, system_markers=S.SYSTEM_MARKERS) -> DataFrame:
    """``messages`` with what a row tells by itself: tokens, accuracy, and _human (a user's own words),
    _marker (system whatever else), _result (the first tool result), _call (the tool called), _other (its
    category if it is neither the last human text nor a tool's)."""
    m = with_tokens(messages)
    human = (F.col("type") == "user") & (F.col("role") == "user") & ~has_block("tool_result")
    is_call = (F.col("type") == "assistant") & (F.col("content_kind") == "array") & has_block("tool_use") & ~has_block("text")
    marker = F.coalesce(F.col("is_compact_summary"), F.lit(False)) | (F.col("type") == "system") | ((F.col("idx") == 0) & F.coalesce(F.col("role") == "user", F.lit(False)) & has_markers(system_markers, thinking=False))
    m = m.withColumns({"_human": F.coalesce(human, F.lit(False)), "_marker": marker, "_is_call": is_call, "_call": F.when(is_call, first_block("tool_use")["name"])})
    m = m.withColumn("_result", F.when((F.col("type") == "user") & (F.col("content_kind") == "array"), first_block("tool_result")))
    return m.withColumn("_other", F.when(F.col("_marker"), "system").when(has_markers(state_markers, thinking=True), "state").otherwise("conversation"))


def tool_category(tool: Column) -> Column:
    return F.when(F.coalesce(tool.isin(*S.RETRIEVAL_TOOLS), F.lit(False)), "retrieved").otherwise("tools")


def classify(messages: DataFrame, state_markers=S.STATE_MARKERS, system_markers=S.SYSTEM_MARKERS) -> DataFrame:
    """``messages`` with category, tool_name, tokens, accuracy and the running token sum."""
    m = row_marks(messages, state_markers, system_markers)
    names = tool_names(messages).withColumnsRenamed({"id": "_id", "name": "_result_tool"})
    m = m.join(names.withColumnRenamed("session_id", "_s"), (F.col("session_id") == F.col("_s")) & (F.col("_result.tool_use_id") == F.col("_id")), "left")
    m = m.withColumn("_last", F.max(F.when(F.col("_human"), F.col("idx"))).over(by_session()))
    is_result = F.col("_result").isNotNull()
    tool = F.when(F.col("_is_call"), F.col("_call")).when(is_result, F.col("_result_tool"))
    is_last = F.col("_human") & (F.col("idx") == F.col("_last"))
    as_tool = ~F.col("_marker") & ~is_last & (F.col("_is_call") | is_result)
    category = F.when(F.col("_marker"), "system").when(is_last, "user").when(as_tool, tool_category(tool)).otherwise(F.col("_other"))
    m = m.withColumns({"category": category, "tool_name": F.when(as_tool, tool)})
    m = m.withColumn("cumulative_tokens", F.sum("tokens").over(so_far()))
    return m.drop("_human", "_marker", "_is_call", "_call", "_other", "_result", "_s", "_id", "_result_tool", "_last")


def category_order(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in S.CATEGORIES)), c).cast("bigint")


def buckets(classified: DataFrame, overhead: DataFrame | None = None, framing: DataFrame | None = None) -> DataFrame:
    """Six rows for each session: tokens, message count, share in percent and accuracy.

    ``overhead`` has rows (session_id, category, tokens, estimated) to add; ``framing`` has
    rows (session_id, tokens_per_message).
    """
    parts = classified.select("session_id", "category", "tokens", F.lit(1).alias("n"), (F.col("accuracy") == "estimated").alias("estimated"))
    if overhead is not None:
        parts = parts.unionByName(overhead.withColumn("n", F.lit(0)))
    sums = parts.groupBy("session_id", "category").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n_messages"), F.bool_or("estimated").alias("estimated"))
    if framing is not None:
        sums = sums.join(framing, "session_id", "left")
        extra = F.col("n_messages") * F.coalesce("tokens_per_message", F.lit(0))
        sums = sums.select("session_id", "category", (F.col("tokens") + extra).alias("tokens"), "n_messages", (F.col("estimated") | (extra > 0)).alias("estimated"))
    return _six_rows(sums)


def bucket_rows(parts: DataFrame) -> DataFrame:
    """The six rows of each session from partial sums (session_id, category, tokens, n, n_estimated)."""
    return _six_rows(parts.groupBy("session_id", "category").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n_messages"), (F.sum("n_estimated") > 0).alias("estimated")))


def _six_rows(sums: DataFrame) -> DataFrame:
    grid = sums.select("session_id").distinct().select("session_id", F.explode(F.array(*(F.lit(c) for c in S.CATEGORIES))).alias("category"))
    full = grid.join(sums, ["session_id", "category"], "left").select(
        "session_id",
        "category",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        F.when(F.coalesce("estimated", F.lit(False)), "estimated").otherwise("exact").alias("accuracy"),
    )
    total = F.sum("tokens").over(by_session())
    return full.withColumn("percentage", F.when(total > 0, F.col("tokens") / total * 100).otherwise(F.lit(0.0)))


def config_overhead(sessions: DataFrame, prompt: int = 0, builtin: int = S.BUILTIN_SCHEMA_TOKENS, mcp: int = 0, memory: int = 0, derived: DataFrame | None = None) -> DataFrame:
    """Rows of fixed costs for each session: prompt to system, schemas to tools, memory to state."""
    rows = [("system", prompt)] if prompt > 0 else []
    rows += [("tools", builtin + mcp)] + ([("state", memory)] if memory > 0 else [])
    listed = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(n).cast("bigint").alias("tokens")) for c, n in rows))
    out = sessions.select("session_id").distinct().select("session_id", F.explode(listed).alias("r")).select("session_id", "r.category", "r.tokens", F.lit(True).alias("estimated"))
    if derived is not None:
        out = out.unionByName(derived.select("session_id", F.lit("system").alias("category"), F.col("tokens"), F.lit(True).alias("estimated")))
    return out


def session_costs(sessions: DataFrame, configs: DataFrame, project: Column, builtin: int = S.BUILTIN_SCHEMA_TOKENS) -> DataFrame:
    """Rows (session_id, prompt, builtin, memory, skill_tokens): the fixed costs of each session by its
    ``project``; ``configs`` are rows of ``sources.configs.project_configs``. A project without a row costs only the built-in tools."""
    zero = F.lit(0).cast("bigint")
    own = sessions.select("session_id", project.alias("project")).distinct().join(configs, "project", "left")
    return own.select("session_id", F.coalesce("prompt", zero).alias("prompt"), F.lit(builtin).cast("bigint").alias("builtin"), F.coalesce("memory", zero).alias("memory"), F.coalesce("skill_tokens", zero).alias("skill_tokens"))


def cost_rows(costs: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """The fixed costs of each session by category, as ``config_overhead`` gives them for one configuration."""
    listed = F.array(*(F.struct(F.lit(c).alias("category"), F.col(n).alias("tokens")) for c, n in (("system", "prompt"), ("tools", "builtin"), ("state", "memory"))))
    out = costs.select("session_id", F.explode(listed).alias("r")).filter("r.tokens > 0").select("session_id", "r.category", "r.tokens", F.lit(True).alias("estimated"))
    if derived is not None:
        out = out.unionByName(derived.select("session_id", F.lit("system").alias("category"), "tokens", F.lit(True).alias("estimated")))
    return out


def effective_window(messages: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """Rows (session_id, effective): input of the last real assistant call, from ``since`` on. Every session has
    a row; effective is null without such a call, as after a boundary that ends its session."""
    eff = effective_input()
    real = (F.col("type") == "assistant") & ~F.coalesce(F.col("model") == S.SYNTHETIC, F.lit(False)) & (eff > 0)
    m = messages
    if since is not None:
        m = m.join(since, "session_id", "left")
        real = real & (F.col("idx") >= F.coalesce("start_idx", F.lit(0)))
    return m.groupBy("session_id").agg(F.max_by(eff, F.when(real, F.col("idx"))).alias("effective"))


def context_limits(messages: DataFrame, model: DataFrame) -> DataFrame:
    """Rows (session_id, context_limit, signal): by model id, else by usage, else the default.

    ``model`` has rows (session_id, current_model).
    """
    from ..functions.text import DEFAULT_LIMIT, LONG_LIMIT, context_limit

    seen = messages.groupBy("session_id").agg(F.coalesce(F.max(effective_input()) > DEFAULT_LIMIT, F.lit(False)).alias("over"))
    joined = seen.join(model, "session_id", "left")
    long_model = context_limit(F.coalesce("current_model", F.lit(""))) == LONG_LIMIT
    limit = F.when(long_model | F.col("over"), LONG_LIMIT).otherwise(DEFAULT_LIMIT).cast("bigint")
    signal = F.when(long_model, "model-id").when(F.col("over"), "usage").otherwise("default")
    return joined.select("session_id", limit.alias("context_limit"), signal.alias("signal"))


def runs_command(commands: tuple[str, ...], tool: str = "Bash") -> Column:
    """A call of the shell tool whose command holds one of ``commands``."""
    said = lambda b: _any_of(F.coalesce(F.get_json_object(b["input_json"], "$.command"), F.lit("")), commands)
    return F.coalesce(F.exists("blocks", lambda b: (b["type"] == "tool_use") & (b["name"] == tool) & said(b)), F.lit(False))


def shows_output(marks: tuple[str, ...]) -> Column:
    """A tool result whose text holds one of ``marks``."""
    return F.coalesce(F.exists("blocks", lambda b: (b["type"] == "tool_result") & _any_of(F.coalesce(b["content_str"], F.lit("")), marks)), F.lit(False))


def without_own_turn(messages: DataFrame, commands: tuple[str, ...] = S.OWN_COMMANDS, marks: tuple[str, ...] = S.OWN_MARKS) -> DataFrame:
    """``messages`` up to the turn in which the analyser itself was run, if the session ends with one."""
    cuts = cutoff(messages, runs_command(commands), shows_output(marks)).select("session_id", "cutoff")
    return messages.join(cuts, "session_id").filter("idx < cutoff").drop("cutoff")


def cutoff(messages: DataFrame, is_own_call: Column, is_own_result: Column) -> DataFrame:
    """Rows (session_id, n, cutoff): where a trailing run of the analyser's own turn begins.

    Phase 1 drops trailing calls and results that the predicates name, phase 2 the assistant
    text before them, phase 3 the user text that asked for it.
    """
    own = F.coalesce(((F.col("type") == "assistant") & is_own_call) | ((F.col("type") == "user") & is_own_result), F.lit(False))
    only_text = F.coalesce(~F.exists("blocks", lambda b: ~b["type"].isin("text", "thinking")), F.lit(True))
    prose = (F.col("type") == "assistant") & ((F.col("content_kind") != "array") | only_text)
    rows = messages.select("session_id", "idx", own.alias("own"), prose.alias("prose"), ((F.col("type") == "user") & ~has_block("tool_result")).alias("asks"))
    first = rows.groupBy("session_id").agg((F.max("idx") + 1).alias("n"), F.coalesce(F.max(F.when(~F.col("own"), F.col("idx"))) + 1, F.lit(0)).alias("e1"))
    second = rows.join(first, "session_id").filter("idx < e1").groupBy("session_id").agg(F.coalesce(F.max(F.when(~F.col("prose"), F.col("idx"))) + 1, F.lit(0)).alias("e2"))
    ends = first.join(second, "session_id", "left").withColumn("e2", F.when(F.col("e1") == F.col("n"), F.col("n")).otherwise(F.coalesce("e2", F.lit(0))))
    third = rows.filter("asks").select("session_id", (F.col("idx") + 1).alias("e2"), F.lit(True).alias("drop"))
    out = ends.join(third, ["session_id", "e2"], "left")
    trimmed = (F.col("e1") < F.col("n")) & F.coalesce("drop", F.lit(False))
    return out.select("session_id", "n", F.when(trimmed, F.col("e2") - 1).otherwise(F.col("e2")).alias("cutoff"))
