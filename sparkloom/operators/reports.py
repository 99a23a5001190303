"""Comparisons, trends, calibration and benchmark runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.text import WHITE, csv_field, file_refs, js_trim
from . import classify as C
from .classify import by_session

# --- comparison -----------------------------------------------------------------


def compare(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Six rows for each pair (session_a, session_b): tokens, delta and percent by category."""
    b = buckets.select("session_id", "category", "tokens")
    a = pairs.join(b.withColumnsRenamed({"session_id": "session_a", "tokens": "tokens_a"}), "session_a")
    j = a.join(b.withColumnsRenamed({"session_id": "session_b", "tokens": "tokens_b"}), ["session_b", "category"])
    delta = F.col("tokens_b") - F.col("tokens_a")
    pct = F.when(F.col("tokens_a") > 0, delta / F.col("tokens_a") * 100).when(F.col("tokens_b") > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return j.select("session_a", "session_b", "category", "tokens_a", "tokens_b", delta.alias("delta"), pct.alias("delta_percent"))


def insights(compared: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (session_a, session_b, insights): a line on each thing that stands out between two sessions.

    ``counts`` has rows (session_id, n_waste, n_compactions, total).
    """
    pivoted = compared.groupBy("session_a", "session_b").agg(
        F.max(F.when(F.col("category") == "tools", F.struct("delta", "delta_percent"))).alias("t"),
        F.max(F.when(F.col("category") == "conversation", F.struct("delta", "delta_percent"))).alias("c"),
    )
    for side in "ab":
        own = counts.select(F.col("session_id").alias(f"session_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("n_waste", "n_compactions", "total")))
        pivoted = pivoted.join(own, f"session_{side}")
    wa, wb, ca, cb, ta, tb = (F.col(x) for x in ("n_waste_a", "n_waste_b", "n_compactions_a", "n_compactions_b", "total_a", "total_b"))
    side = lambda d: F.when(d > 0, "b").otherwise("a")
    count = lambda n: F.format_number(F.abs(n), 0)
    found = F.array_compact(
        F.array(
            F.when(F.abs("t.delta_percent") > 15, F.concat(F.lit("more tool tokens in "), side(F.col("t.delta")), F.lit(": "), count(F.col("t.delta")))),
            F.when(F.abs("c.delta_percent") > 10, F.concat(F.lit("more conversation tokens in "), side(F.col("c.delta")), F.lit(": "), count(F.col("c.delta")))),
            F.when(((wa > 0) & (wb >= 2 * wa)) | ((wb > 0) & (wa >= 2 * wb)) | ((wa == 0) & (wb > 0)) | ((wb == 0) & (wa > 0)), F.concat(F.lit("more waste in "), side(wb - wa), F.lit(": a "), wa, F.lit(", b "), wb)),
            F.when(((ca > 0) | (cb > 0)) & (ca != cb), F.concat(F.when((ca > 0) & (cb > 0), "both compacted").otherwise(F.concat(F.lit("only compacted in "), side(cb - ca))), F.lit(": a "), ca, F.lit(", b "), cb)),
            F.when((ta > 0) & (F.abs(tb - ta) / ta * 100 > 20), F.concat(F.lit("more tokens in all in "), side(tb - ta), F.lit(": "), count(tb - ta), F.lit(", "), F.floor(F.abs(tb - ta) / ta * 100 + 0.5), F.lit(" percent"))),
        )
    )
    return pivoted.select("session_a", "session_b", F.array_join(found, "\n").alias("insights"))


def cut_buckets(messages: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """Rows (session_id, cut, category, tokens, n_messages, accuracy): each session as it was at each cut,
    holding its first rows up to the cut (between 1 and its length). One pass, however many cuts.

    A row counts from the first cut after it. What later rows change goes into the same sums as
    moves: the last human text enters ``user`` and leaves it for its other category at the cut that
    has a later one, and a tool result changes category when a later call takes its id."""
    cuts = tuple(sorted({max(1, int(c)) for c in cuts}))
    edges = F.array(*(F.lit(c).cast("bigint") for c in cuts))
    slot = F.size(F.filter(edges, lambda c: c <= F.col("idx")))
    m = C.row_marks(messages).withColumn("slot", slot.cast("bigint"))
    last = len(cuts) - 1
    estimated = (F.col("accuracy") == "estimated").cast("bigint")
    result = F.col("_result").isNotNull() & ~F.col("_marker") & ~F.col("_is_call")
    category = F.when(F.col("_marker"), "system").when(F.col("_is_call"), C.tool_category(F.col("_call"))).otherwise(F.col("_other"))
    rows = m.filter(F.col("slot") <= last)
    sums = (F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.sum(estimated).alias("n_estimated"))
    parts = [rows.filter(~result).groupBy("session_id", "slot", category.alias("category")).agg(*sums)]

    def moved(df: DataFrame, at: str, to: Column, sign: int) -> DataFrame:
        return df.select("session_id", F.col(at).alias("slot"), to.alias("category"), *((F.col(c) * sign).alias(c) for c in ("tokens", "n", "n_estimated")))

    # the last human text of each slot holds until the next slot that has one
    human = rows.filter("_human").groupBy("session_id", "slot").agg(F.max(F.struct("idx", "tokens", F.col("_other").alias("other"), F.col("_marker").alias("marker"), estimated.alias("n_estimated"))).alias("h"))
    human = human.withColumn("until", F.lead("slot").over(by_session().orderBy("slot"))).filter("NOT h.marker")
    human = human.select("session_id", "slot", "until", "h.tokens", F.lit(1).alias("n"), "h.n_estimated", "h.other")
    gone = human.filter("until IS NOT NULL")
    parts += [moved(human, "slot", F.lit("user"), 1), moved(human, "slot", F.col("other"), -1), moved(gone, "until", F.lit("user"), -1), moved(gone, "until", F.col("other"), 1)]
    # a result is a tool's before any call has its id, then by the last name of each slot
    results = rows.filter(result).groupBy("session_id", F.coalesce("_result.tool_use_id", F.lit("")).alias("id"), F.col("slot").alias("own")).agg(*sums)
    named = C.tool_uses(rows).filter("id <> '' AND name <> ''").join(rows.select("session_id", "idx", "slot"), ["session_id", "idx"])
    named = named.groupBy("session_id", "id", "slot").agg(F.max_by("name", F.struct("idx", "pos")).alias("name"))
    named = named.select("session_id", "id", F.col("slot").alias("since"), F.lead("slot").over(Window.partitionBy("session_id", "id").orderBy("slot")).alias("until"), C.tool_category(F.col("name")).alias("category"))
    first = named.groupBy("session_id", "id").agg(F.min("since").alias("until")).select("session_id", "id", F.lit(-1).cast("bigint").alias("since"), "until", F.lit("tools").alias("category"))
    spans = results.join(named.unionByName(first), ["session_id", "id"]).withColumn("slot", F.greatest("own", "since"))
    spans = spans.filter(F.col("until").isNull() | (F.col("slot") < F.col("until")))
    never = results.join(first, ["session_id", "id"], "left_anti").withColumn("category", F.lit("tools"))
    parts += [moved(spans, "slot", F.col("category"), 1), moved(spans.filter("until IS NOT NULL"), "until", F.col("category"), -1), moved(never, "own", F.col("category"), 1)]

    deltas = reduce(lambda x, y: x.unionByName(y), parts).groupBy("session_id", "slot", "category").agg(*(F.sum(c).alias(c) for c in ("tokens", "n", "n_estimated")))
    grid = messages.select("session_id").distinct().select("session_id", F.posexplode(edges).alias("slot", "cut")).withColumn("category", F.explode(F.array(*(F.lit(c) for c in S.CATEGORIES))))
    upto = Window.partitionBy("session_id", "category").orderBy("slot")
    sofar = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(upto)
    return grid.join(deltas, ["session_id", "slot", "category"], "left").select("session_id", "cut", "category", sofar("tokens").alias("tokens"), sofar("n").alias("n_messages"), F.when(sofar("n_estimated") > 0, "estimated").otherwise("exact").alias("accuracy"))


def session_diff(at_cuts: DataFrame, start: int, end: int) -> DataFrame:
    """Category tokens of each session at two cuts, from ``cut_buckets``."""
    if start >= end:
        raise ValueError("the first cut must lie before the second")
    c = F.col("cut")
    g = at_cuts.groupBy("session_id", "category").agg(F.sum(F.when(c == start, F.col("tokens"))).alias("tokens_from"), F.sum(F.when(c == end, F.col("tokens"))).alias("tokens_to"))
    return g.withColumn("delta", F.col("tokens_to") - F.col("tokens_from"))


# --- trends ---------------------------------------------------------------------


def trend_history(records: DataFrame, project: str | None = None, last: int | None = None) -> DataFrame:
    """The latest record of each session, oldest first; equal times keep the earlier line.

    records: session_id, ts, line, project, percent_used, top_category and further columns."""
    r = records if project is None else records.filter(F.lower("project").contains(project.lower()))
    newest = r.withColumn("r", F.row_number().over(by_session().orderBy(F.desc("ts"), "line"))).filter("r = 1").drop("r")
    if last is not None:
        newest = newest.orderBy(F.desc("ts"), F.desc("line")).limit(last)
    return newest


def trend_summary(history: DataFrame, by: str) -> DataFrame:
    """Averages, dominant category and direction for each group of ``by``, in order of time.

    The ends are compared by their mean over a third of the records; groups shuffle once
    on the key and positions come from one window over it."""
    w = Window.partitionBy(by)
    o = w.orderBy("ts", "session_id")
    n = F.count(F.lit(1)).over(w)
    third = F.greatest(F.lit(1), F.floor(n / 3))
    h = history.withColumns({"n": n, "pos": F.row_number().over(o), "third": third})
    main = h.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("percent_used").alias("avg_percent"),
        F.avg(F.when(F.col("pos") <= F.col("third"), F.col("percent_used"))).alias("first_avg"),
        F.avg(F.when(F.col("pos") > F.col("n") - F.col("third"), F.col("percent_used"))).alias("last_avg"),
    )
    cats = h.groupBy(by, "top_category").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("p"))
    mode = cats.groupBy(by).agg(F.max_by("top_category", F.struct("c", -F.col("p"))).alias("dominant_category"))
    delta = F.when(F.col("n") >= 3, F.col("last_avg") - F.col("first_avg")).otherwise(F.lit(0.0))
    j = main.join(mode, by)
    return j.select(by, "n", "avg_percent", "dominant_category", delta.alias("percent_delta"), F.when(delta > 5, "worsening").when(delta < -5, "improving").otherwise("flat").alias("direction"))


#: The columns of an exported history.
TREND_COLUMNS = ("sessionId", "projectName", "timestamp", "totalTokens", "percentUsed", "messageCount", "compactionCount", "health", "topCategory", "topCategoryTokens", "contextLimit")


def two_decimals(x: Column) -> Column:
    """A number that is not negative with two decimals, by its exact binary value, halves up."""
    half = (x * 8 == F.floor(x * 8)) & (F.pmod(x * 1000, F.lit(10)) == 5)
    return F.call_function("format_number", F.when(half, x + 0.001).otherwise(x), F.lit("0.00"))


def trend_csv(history: DataFrame, columns: tuple[str, ...] = TREND_COLUMNS) -> DataFrame:
    """One CSV line for each record, nulls as empty fields; fractions have two decimals."""
    kinds = dict(history.dtypes)

    def field(c: str) -> Column:
        shown = two_decimals(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
        return csv_field(F.coalesce(shown, F.lit("")))

    kept = [c for c in ("ts",) if c in history.columns]
    return history.select(*kept, F.concat_ws(",", *map(field, columns)).alias("line"))


def top_category(buckets: DataFrame) -> DataFrame:
    """Rows (session_id, top_category, tokens): the largest bucket, ties in bucket order."""
    order = F.array_position(F.array(*(F.lit(x) for x in S.CATEGORIES)), F.col("category"))
    return buckets.groupBy("session_id").agg(F.max_by("category", F.struct("tokens", -order)).alias("top_category"), F.max("tokens").alias("tokens"))


# --- calibration ----------------------------------------------------------------

# Words that name each calibrated bucket, in the order they are tried.
CALIBRATION_LABELS = (
    ("system_prompt", ("system prompt", "system instructions")),
    ("system_tools", ("system tool", "built-in tool", "tools")),
    ("custom_agents", ("custom agent", "agent")),
    ("memory_files", ("memory file", "memory", "memdir")),
    ("mcp_tools", ("mcp tool", "mcp")),
    ("messages", ("message", "conversation")),
    ("free_space", ("free space", "free", "remaining", "available")),
    ("total", ("total", "capacity", "context window")),
)
_USED = ("system_prompt", "system_tools", "custom_agents", "memory_files", "mcp_tools", "messages")


def token_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (id, pos, label, tokens) of pasted usage lines like ``Label: 12,300 tokens``; others are skipped."""
    lines = df.select("id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rx = rf"(?i)^[{WHITE}]*([^:]+):[{WHITE}]*([0-9,]+)[{WHITE}]*(?:tokens?)?[{WHITE}]*$"
    number = F.expr("try_cast(regexp_replace(num, ',', '') AS BIGINT)")
    got = lines.select("id", "pos", F.lower(js_trim(F.regexp_extract("line", rx, 1))).alias("label"), F.regexp_extract("line", rx, 2).alias("num"))
    return got.withColumn("tokens", number).filter("tokens IS NOT NULL").drop("num")


def parse_context_output(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each id with a usable text: the calibrated buckets, total_used and total_capacity.

    A later line of a label wins. A bucket's words are tried in order; each asks the first label that
    holds it, and the first answer above 0 counts."""
    labels = token_lines(df, text).groupBy("id", "label").agg(F.max_by("tokens", "pos").alias("tokens"), F.min("pos").alias("first"))
    asked = [(b, w) for b, words in CALIBRATION_LABELS for w in words]
    wide = labels.groupBy("id").agg(*(F.min_by("tokens", F.when(F.col("label").contains(w), F.col("first"))).alias(f"w{k}") for k, (_, w) in enumerate(asked)))
    picked = lambda b: F.coalesce(*(F.when(F.col(f"w{k}") > 0, F.col(f"w{k}")) for k, (x, _) in enumerate(asked) if x == b), F.lit(0)).cast("bigint")
    out = wide.select("id", *(picked(b).alias(b) for b, _ in CALIBRATION_LABELS))
    used = reduce(lambda x, y: x + y, (F.col(b) for b in _USED))
    out = out.withColumn("total_used", used).filter("total_used > 0 OR free_space > 0")
    return out.withColumn("total_capacity", F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("total_used") + F.col("free_space"))).drop("total")


def calibrate(buckets: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows (id, bucket, estimated, actual, delta_percent) where either side is above 0.

    buckets: (id, category, tokens), the estimates; actual: rows of ``parse_context_output``."""
    mine = lambda *cats: F.coalesce(F.sum(F.when(F.col("category").isin(*cats), F.col("tokens"))), F.lit(0))
    est = buckets.groupBy("id").agg(mine("system").alias("e1"), mine("tools").alias("e2"), mine("conversation", "retrieved", "user").alias("e3"), mine("state").alias("e4"))
    zero = F.lit(0).cast("bigint")
    sides = (("System prompt", F.col("e1"), F.col("system_prompt")), ("Tools", F.col("e2"), F.col("system_tools") + F.col("mcp_tools")), ("Messages", F.col("e3"), F.col("messages")), ("Memory", F.col("e4"), F.col("memory_files")), ("Custom agents", zero, F.col("custom_agents")))
    rows = F.array(*(F.struct(F.lit(n).alias("bucket"), e.alias("estimated"), x.alias("actual")) for n, e, x in sides))
    j = est.join(actual, "id").select("id", F.explode(rows).alias("r")).select("id", "r.*").filter("estimated > 0 OR actual > 0")
    return j.withColumn("delta_percent", F.when(F.col("actual") > 0, (F.col("estimated") - F.col("actual")) / F.col("actual") * 100).otherwise(F.lit(0.0)))


def calibration_accuracy(compared: DataFrame, builtin: int = S.BUILTIN_SCHEMA_TOKENS) -> DataFrame:
    """Rows (id, accuracy, stale): agreement of the sums, and whether the schema table is off by over 5 % of
    the measured tools, servers' included."""
    g = compared.groupBy("id").agg(F.sum("estimated").alias("e"), F.sum("actual").alias("a"), F.max(F.when(F.col("bucket") == "Tools", F.col("actual"))).alias("t"))
    return g.select("id", F.when(F.col("a") > 0, 100 - F.abs(F.col("e") - F.col("a")) / F.col("a") * 100).alias("accuracy"), F.coalesce((F.col("t") > 0) & (F.abs(F.col("t") - builtin) / F.col("t") * 100 > 5), F.lit(False)).alias("stale"))


# --- benchmark runs -------------------------------------------------------------

SNAPSHOT = ("tokens_total", "tokens_current", "usage_percentage", "message_count", "waste_count", "compaction_count", "context_limit")


def snapshot_delta(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Field by field, b less a, for snapshots joined on ``key``."""
    right = b.select(key, *(F.col(c).alias(f"_{c}") for c in SNAPSHOT))
    return a.join(right, key).select(key, *((F.col(f"_{c}") - F.col(c)).alias(c) for c in SNAPSHOT))


def survivor_diff(runs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """File references of two summaries: in both and in one only, as sorted joined lists."""
    r = runs.select(key, file_refs(F.col(a)).alias("ra"), file_refs(F.col(b)).alias("rb"))
    return r.select(
        key,
        F.array_join(F.array_except("ra", "rb"), ",").alias("only_a"),
        F.array_join(F.array_except("rb", "ra"), ",").alias("only_b"),
        F.array_join(F.array_intersect("ra", "rb"), ",").alias("in_both"),
        (F.size("rb") - F.size("ra")).cast("bigint").alias("coverage_delta"),
    )


def reclaim_ratio(runs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """similar within a tenth, else which run reclaimed more and by how many percent."""
    ratio = F.col(b) / F.col(a)
    both = (F.col(a) > 0) & (F.col(b) > 0)
    return runs.select(key, F.when(both, F.when(F.abs(1 - ratio) < 0.1, "similar").when(ratio > 1, "b").otherwise("a")).alias("more"), F.when(both & (F.abs(1 - ratio) >= 0.1), F.floor(F.when(ratio > 1, ratio - 1).otherwise(1 / ratio - 1) * 100 + 0.5).cast("bigint")).alias("percent"))


def run_insights(compared: DataFrame, preview: int = 5) -> DataFrame:
    """Rows (key, insights): lines on what two runs kept and reclaimed.

    compared: key, refs_a, refs_b (arrays of file references), reclaimed_a, reclaimed_b."""
    a, b = F.col("refs_a"), F.col("refs_b")
    only = lambda x, y: F.array_sort(F.array_except(x, y))
    listed = lambda x: F.concat(F.array_join(F.slice(x, 1, preview), ", "), F.when(F.size(x) > preview, F.concat(F.lit(", and "), F.size(x) - preview, F.lit(" more"))).otherwise(""))
    more = F.size(b) - F.size(a)
    x, y = F.col("reclaimed_a"), F.col("reclaimed_b")
    ratio = y / x
    percent = F.floor(F.when(ratio > 1, ratio - 1).otherwise(1 / ratio - 1) * 100 + 0.5)
    found = F.array(
        F.when((F.size(a) > 0) | (F.size(b) > 0), F.when(more > 0, F.concat(F.lit("b names more files by "), more)).when(more < 0, F.concat(F.lit("a names more files by "), -more)).otherwise(F.concat(F.lit("both name as many files: "), F.size(a)))),
        F.when(F.size(only(b, a)) > 0, F.concat(F.lit("only in b: "), listed(only(b, a)))),
        F.when(F.size(only(a, b)) > 0, F.concat(F.lit("only in a: "), listed(only(a, b)))),
        F.when((x > 0) & (y > 0), F.when(F.abs(1 - ratio) < 0.1, "both reclaimed about as much").otherwise(F.concat(F.when(ratio > 1, "b").otherwise("a"), F.lit(" reclaimed more by "), percent, F.lit(" percent")))),
    )
    return compared.select("key", F.array_join(F.array_compact(found), "\n").alias("insights"))


def worst_status(checks: DataFrame, by: str) -> DataFrame:
    """fail beats warn beats ok."""
    rank = F.array_position(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.col("status"))
    return checks.groupBy(by).agg(F.max_by("status", rank).alias("status"), F.count(F.lit(1)).alias("n_checks"))


def snapshots(state: DataFrame, totals: DataFrame, waste: DataFrame, since: DataFrame) -> DataFrame:
    """The fields of ``SNAPSHOT`` for each session. totals: (session_id, tokens_total, message_count)."""
    w = waste.groupBy("session_id").agg(F.count(F.lit(1)).alias("waste_count"))
    j = state.join(totals, "session_id").join(w, "session_id", "left").join(since.select("session_id", "n_compactions"), "session_id", "left")
    return j.select(
        "session_id",
        "tokens_total",
        F.col("total").alias("tokens_current"),
        F.col("percentage").alias("usage_percentage"),
        "message_count",
        F.coalesce("waste_count", F.lit(0)).alias("waste_count"),
        F.coalesce("n_compactions", F.lit(0)).alias("compaction_count"),
        "context_limit",
    )


def summary_refs(messages: DataFrame) -> DataFrame:
    """Rows (session_id, refs): file references in the first summary after the last boundary."""
    from .tokens import message_text

    m = messages.select("session_id", "idx", (F.coalesce((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"), F.lit(False))).alias("b"), F.coalesce("is_compact_summary", F.lit(False)).alias("s"), message_text().alias("text"))
    last = m.filter("b").groupBy("session_id").agg(F.max("idx").alias("at"))
    after = m.filter("s").join(last, "session_id").filter("idx > at").groupBy("session_id").agg(F.min_by("text", "idx").alias("text"))
    return after.select("session_id", F.array_join(file_refs(F.col("text")), ",").alias("refs"))


def trend_records(state: DataFrame, buckets: DataFrame, since: DataFrame, sizes: DataFrame) -> DataFrame:
    """One record of each session for the history log, from the live window. sizes: (session_id, n)."""
    j = state.join(top_category(buckets), "session_id").join(since.select("session_id", "n_compactions"), "session_id", "left").join(sizes, "session_id")
    return j.select("session_id", F.col("total").alias("total_tokens"), F.col("percentage").alias("percent_used"), F.col("n").alias("message_count"), F.coalesce("n_compactions", F.lit(0)).alias("compaction_count"), "health", "top_category", F.col("tokens").alias("top_category_tokens"), "context_limit")
