"""What in a window is waste, and which noise paths are read.

Detectors read classified rows. Indices are given twice: idx in the session and rel_idx
from the start of the live window. Texts are derived last, from the structured columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.text import CHARS_PER_TOKEN_CODE, filename, js_len, js_trim, normal_path
from .classify import in_order, by_session, has_block, tool_names, tool_uses
from .mentions import last_mentions
from .tokens import effective_input

COLUMNS = ("session_id", "type", "severity", "tokens", "first_idx", "last_idx", "filename", "n_reads", "detail")
_ORDINAL = {t: k for k, t in enumerate(("stale_read", "duplicate_read", "oversized_system", "resolved_exchange", "cache_overhead", "unused_result"))}


def _with_next(classified: DataFrame) -> DataFrame:
    return classified.select("session_id", "idx", F.lead("tokens").over(in_order()).alias("next_tokens"), F.lead("tool_name").over(in_order()).alias("next_tool"), F.count(F.lit(1)).over(by_session()).alias("n"), F.min("idx").over(by_session()).alias("start"))


def file_reads(classified: DataFrame) -> DataFrame:
    """Reads with the tokens of the next row, which hold the content if they are of a read."""
    calls = tool_uses(classified).filter(F.col("name").isin(*S.READ_TOOLS) & (F.col("path") != ""))
    cost = F.when(F.col("next_tool").isin(*S.READ_TOOLS), F.col("next_tokens")).otherwise(F.lit(0))
    return calls.join(_with_next(classified), ["session_id", "idx"]).select("session_id", "idx", "pos", "id", "path", cost.cast("bigint").alias("tokens"), F.coalesce("next_tokens", F.lit(0)).alias("next_tokens"), "n", "start")


def file_edits(classified: DataFrame) -> DataFrame:
    calls = tool_uses(classified).filter(F.col("name").isin(*S.EDIT_TOOLS) & (F.col("path") != ""))
    return calls.select("session_id", "idx", normal_path(F.col("path")).alias("norm"))


def _row_texts(classified: DataFrame) -> DataFrame:
    """Rows (session_id, idx, text) in which a file may be mentioned."""
    parts = F.transform("blocks", lambda b: F.concat_ws(" ", b["text"], b["thinking"], b["content_str"]))
    text = F.coalesce(F.when(F.col("content_kind") == "string", F.col("content_str")).otherwise(F.array_join(parts, " ")), F.lit(""))
    return classified.select("session_id", "idx", text.alias("text")).filter("text <> ''")


def stale_reads(classified: DataFrame, min_age: int = 15) -> DataFrame:
    """Reads of more than ``min_age`` rows ago whose file no later row (from the second on) names."""
    r = file_reads(classified).withColumn("age", F.col("n") - (F.col("idx") - F.col("start"))).filter((F.col("age") > min_age) & (F.col("tokens") != 0))
    r = r.withColumn("filename", filename(F.col("path")))
    last = last_mentions(r.select("session_id", F.col("filename").alias("name")), _row_texts(classified)).withColumnRenamed("name", "filename")
    r = r.join(last, ["session_id", "filename"], "left").filter(F.coalesce("ti", F.lit(-1)) < F.col("idx") + 2)
    return r.select("session_id", F.lit("stale_read").alias("type"), F.lit("high").alias("severity"), "tokens", F.col("idx").alias("first_idx"), (F.col("idx") + 1).alias("last_idx"), "filename", F.lit(1).cast("bigint").alias("n_reads"), F.col("age").cast("string").alias("detail"))


def read_pairs(classified: DataFrame) -> DataFrame:
    """Consecutive reads of one path, with whether an edit of it lies strictly between."""
    w = Window.partitionBy("session_id", "norm").orderBy("idx", "pos")
    r = file_reads(classified).withColumn("norm", normal_path(F.col("path")))
    r = r.withColumns({"next_idx": F.lead("idx").over(w), "n_reads": F.count(F.lit(1)).over(Window.partitionBy("session_id", "norm")), "first_path": F.first("path").over(w)})
    e = file_edits(classified).select(F.col("session_id").alias("s"), F.col("norm").alias("en"), F.col("idx").alias("ei"))
    on = (F.col("session_id") == F.col("s")) & (F.col("norm") == F.col("en")) & (F.col("ei") > F.col("idx")) & (F.col("ei") < F.col("next_idx"))
    return r.filter("next_idx IS NOT NULL").join(e, on, "left_anti")


def duplicate_reads(classified: DataFrame) -> DataFrame:
    """Paths of which an earlier read was repeated without an edit between."""
    g = read_pairs(classified).groupBy("session_id", "norm").agg(
        F.sum("tokens").alias("tokens"),
        F.min("idx").alias("first_idx"),
        (F.max("idx") + 1).alias("last_idx"),
        F.min("first_path").alias("path"),
        F.max("n_reads").alias("n_reads"),
        F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda x: (x + 1).cast("string")), ",").alias("detail"),
    )
    return g.filter("tokens > 0").select("session_id", F.lit("duplicate_read").alias("type"), F.lit("medium").alias("severity"), "tokens", "first_idx", "last_idx", filename(F.col("path")).alias("filename"), "n_reads", "detail")


def oversized_system(sessions: DataFrame, prompt_tokens: int, threshold: int = 1500) -> DataFrame:
    none = F.lit(None).cast("bigint")
    rows = sessions.select("session_id").distinct().filter(F.lit(prompt_tokens > threshold))
    return rows.select("session_id", F.lit("oversized_system").alias("type"), F.lit("medium").alias("severity"), F.lit(int(prompt_tokens - threshold)).cast("bigint").alias("tokens"), none.alias("first_idx"), none.alias("last_idx"), F.lit(None).cast("string").alias("filename"), none.alias("n_reads"), F.lit(str(prompt_tokens)).alias("detail"))


def resolved_exchanges(classified: DataFrame, phrases=S.RESOLUTION_PHRASES, lookback: int = 10, min_tokens: int = 500, max_chars: int = 100) -> DataFrame:
    """Short user messages that close an exchange of more than ``min_tokens`` before them."""
    texts = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    text = F.when(F.col("content_kind") == "string", F.col("content_str")).when(F.col("content_kind") == "array", texts)
    low = js_trim(F.lower(text))
    counted = F.when(F.col("category").isin("conversation", "tools", "retrieved"), F.col("tokens"))
    before = F.coalesce(F.sum(counted).over(in_order().rowsBetween(-lookback, -1)), F.lit(0))
    rows = classified.select("session_id", "idx", "type", low.alias("low"), has_block("tool_result").alias("res"), before.alias("tokens"), F.min("idx").over(by_session()).alias("start"))
    closes = reduce(lambda a, b: a | b, (F.col("low").contains(p) for p in phrases))
    hit = rows.filter((F.col("type") == "user") & ~F.col("res") & js_len(F.col("low")).between(1, max_chars) & closes & (F.col("tokens") > min_tokens))
    return hit.select("session_id", F.lit("resolved_exchange").alias("type"), F.lit("high").alias("severity"), "tokens", F.greatest(F.col("start"), F.col("idx") - lookback).alias("first_idx"), F.col("idx").alias("last_idx"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("bigint").alias("n_reads"), F.substring("low", 1, 40).alias("detail"))


def cache_ratio(messages: DataFrame) -> DataFrame:
    """Rows (session_id, cache_read, total_input) over all calls of the whole session."""
    return messages.groupBy("session_id").agg(F.coalesce(F.sum("usage.cache_read_input_tokens"), F.lit(0)).alias("cache_read"), F.coalesce(F.sum(effective_input()), F.lit(0)).alias("total_input"))


def cache_overhead(messages: DataFrame, threshold: float = 0.6) -> DataFrame:
    none = F.lit(None).cast("bigint")
    r = cache_ratio(messages).filter((F.col("total_input") > 0) & (F.col("cache_read") / F.col("total_input") > threshold))
    return r.select("session_id", F.lit("cache_overhead").alias("type"), F.lit("info").alias("severity"), F.lit(0).cast("bigint").alias("tokens"), none.alias("first_idx"), none.alias("last_idx"), F.lit(None).cast("string").alias("filename"), none.alias("n_reads"), F.lit(None).cast("string").alias("detail"))


def unused_results(classified: DataFrame, min_chars: int = 200, min_tokens: int = 100, ahead: int = 4, text_chars: int = 50) -> DataFrame:
    """Large tool results that no assistant text of the next four rows used."""
    names = tool_names(classified).withColumnRenamed("session_id", "ns").withColumnRenamed("id", "nid")
    res = classified.select("session_id", "idx", "tokens", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 'tool_result' AND NOT coalesce(b.is_error, false)")
    res = res.select("session_id", "idx", "pos", "tokens", F.col("b.tool_use_id").alias("use"), F.when(F.col("b.content_kind") == "string", F.col("b.content_str")).otherwise("").alias("content"))
    res = res.filter(js_len(F.col("content")) >= min_chars)
    res = res.join(names, (F.col("session_id") == F.col("ns")) & (F.col("use") == F.col("nid")), "left").filter(~F.coalesce(F.col("name").isin(*S.UNTRACKED_RESULTS), F.lit(False)))
    texts = F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), lambda b: b["text"])
    said = classified.filter((F.col("type") == "assistant") & has_block("text")).select(F.col("session_id").alias("s"), F.col("idx").alias("ai"), F.explode(texts).alias("said"))
    # a text meets each of the rows it may answer by equality
    said = said.withColumn("ri", F.explode(F.sequence(F.col("ai") - ahead, F.col("ai") - 1)))
    mark = js_trim(F.substring("content", 1, 50))
    on = (F.col("session_id") == F.col("s")) & (F.col("idx") == F.col("ri")) & ((js_len(F.col("said")) > text_chars) | ((mark != "") & F.col("said").contains(mark)))
    out = res.join(said, on, "left_anti").filter(F.col("tokens") > min_tokens)
    return out.select("session_id", F.lit("unused_result").alias("type"), F.lit("low").alias("severity"), "tokens", F.col("idx").alias("first_idx"), F.col("idx").alias("last_idx"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("bigint").alias("n_reads"), F.coalesce("name", F.lit("Tool")).alias("detail"))


def detect_waste(classified: DataFrame, messages: DataFrame, since: DataFrame, prompt_tokens: int = 0, **limits) -> DataFrame:
    """All waste of the live windows, ranked within each session.

    ``since`` has rows (session_id, start_idx); limits: stale_age, oversized, cache, lookback.
    """
    from .compaction import slice_from

    live = slice_from(classified, since).drop("rel_idx")
    parts = [
        stale_reads(live, limits.get("stale_age", 15)),
        duplicate_reads(live),
        oversized_system(classified, prompt_tokens, limits.get("oversized", 1500)),
        resolved_exchanges(live, lookback=limits.get("lookback", 10)),
        cache_overhead(messages, limits.get("cache", 0.6)),
        unused_results(live),
    ]
    all_ = reduce(lambda a, b: a.unionByName(b), (p.select(*COLUMNS) for p in parts))
    all_ = all_.join(since.select("session_id", "start_idx"), "session_id", "left").withColumn("start_idx", F.coalesce("start_idx", F.lit(0)))
    severity = F.array_position(F.array(*(F.lit(x) for x in S.SEVERITIES)), F.col("severity"))
    detector = F.array_position(F.array(*(F.lit(x) for x in _ORDINAL)), F.col("type"))
    w = by_session().orderBy(severity, F.desc("tokens"), detector, "first_idx", "filename")
    return all_.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("rel_first", F.col("first_idx") - F.col("start_idx")).drop("start_idx")


def waste_totals(waste: DataFrame) -> DataFrame:
    """Count and tokens by session and severity, with session and grand totals (null keys)."""
    return waste.rollup("session_id", "severity").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens"))


def noise_rule(path):
    """The first noise rule that a path meets, else null."""
    rule = F.lit(None).cast("string")
    for pattern, name in reversed(S.NOISE_PATTERNS):
        rule = F.when(path.rlike(pattern), F.lit(name)).otherwise(rule)
    return rule


def noise_reads(messages: DataFrame) -> DataFrame:
    """Rows (session_id, rule, n_paths, tokens): results of reads of noise paths, by the last
    such read before the result."""
    r = tool_uses(messages).filter((F.col("type") == "assistant") & F.col("name").isin(*S.READ_TOOLS) & (F.col("path") != "") & (F.col("id") != ""))
    r = r.withColumn("rule", noise_rule(F.col("path"))).filter("rule IS NOT NULL").select("session_id", "id", F.struct("idx", "pos", "path", "rule").alias("u"))
    res = messages.filter("type = 'user'").select("session_id", "idx", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 'tool_result'")
    sub = F.coalesce(F.aggregate("b.sub", F.lit(0).cast("bigint"), lambda a, s: a + js_len(s["text"])), F.lit(0))
    size = F.when(F.col("b.content_kind") == "string", js_len(F.col("b.content_str"))).otherwise(sub)
    res = res.select(F.col("session_id").alias("s"), F.col("idx").alias("ri"), F.col("pos").alias("rp"), F.col("b.tool_use_id").alias("use"), F.ceil(size / F.lit(CHARS_PER_TOKEN_CODE)).cast("bigint").alias("tokens"))
    met = r.join(res, (F.col("session_id") == F.col("s")) & (F.col("id") == F.col("use")) & (F.col("u.idx") < F.col("ri")))
    met = met.groupBy("session_id", "ri", "rp").agg(F.max("u").alias("u"), F.max("tokens").alias("tokens"))
    return met.groupBy("session_id", F.col("u.rule").alias("rule")).agg(F.count_distinct("u.path").alias("n_paths"), F.sum("tokens").alias("tokens"))
