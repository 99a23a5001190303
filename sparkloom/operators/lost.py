"""What compactions dropped: content before a boundary that the summary does not mention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema as S
from ..functions.text import filename, is_tool_use_id, js_len, js_trim, key_terms, normal_path, one_line
from ..sources.shared import ship
from .classify import by_session, has_block
from .tokens import message_text

COLUMNS = ("session_id", "event", "type", "first_idx", "last_idx", "tokens", "subject")


def event_windows(events: DataFrame) -> DataFrame:
    """Events numbered from 1, with the rows [window_start, before_idx) that each closed."""
    w = by_session().orderBy("before_idx")
    return events.withColumns({"event": F.row_number().over(w).cast("bigint"), "window_start": F.lag("after_idx", 1, 0).over(w)})


def summaries(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (session_id, event, summary): the text of each event's summary message, lower-cased."""
    text = messages.select("session_id", F.col("idx").alias("summary_idx"), F.lower(message_text()).alias("summary"))
    return events.join(text, ["session_id", "summary_idx"], "left").select("session_id", "event", F.coalesce("summary", F.lit("")).alias("summary"))


def window_rows(classified: DataFrame, events: DataFrame) -> DataFrame:
    """Classified rows with the event whose window holds them.

    Windows do not overlap, so a row can only belong to the next event: one pass backwards over
    each session carries it, with no join of rows and events."""
    e = events.select("session_id", F.col("before_idx").alias("idx"), F.struct("event", "window_start", "before_idx").alias("e"))
    both = classified.unionByName(e, allowMissingColumns=True)
    back = by_session().orderBy(F.desc("idx"), F.col("e").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"mark": F.col("e").isNotNull(), "e": F.last("e", ignorenulls=True).over(back)})
    return both.filter(~F.col("mark") & (F.col("idx") >= F.col("e.window_start"))).select(*classified.columns, "e.event", "e.window_start", "e.before_idx")


def _mentions(terms, summary):
    return F.exists(terms, lambda t: summary.contains(F.lower(t)))


def lost_file_reads(rows: DataFrame, said: DataFrame) -> DataFrame:
    """First read of each path in a window, unless the summary names the file."""
    calls = rows.select("session_id", "event", "idx", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 'tool_use'")
    raw = F.coalesce(F.get_json_object("b.input_json", "$.file_path"), F.get_json_object("b.input_json", "$.path"))
    calls = calls.filter(F.col("b.name").isin(*S.READ_TOOLS)).withColumn("path", raw).filter("path <> ''")
    bare = F.regexp_replace(filename(F.col("path")), r"\.\w+$", "")
    calls = calls.withColumn("path", F.when(is_tool_use_id(bare), "Agent sub-task result").otherwise(F.col("path")))
    w = Window.partitionBy("session_id", "event", normal_path(F.col("path"))).orderBy("idx", "pos")
    firsts = calls.withColumn("r", F.row_number().over(w)).filter("r = 1").select("session_id", "event", "idx", "path")
    nxt = rows.select("session_id", "event", (F.col("idx") - 1).alias("idx"), "tokens")
    j = firsts.join(nxt, ["session_id", "event", "idx"], "left").join(said, ["session_id", "event"])
    name = filename(F.col("path"))
    return j.filter(~F.col("summary").contains(F.lower(name))).select("session_id", "event", F.lit("file_read").alias("type"), F.col("idx").alias("first_idx"), (F.col("idx") + 1).alias("last_idx"), F.coalesce("tokens", F.lit(0)).alias("tokens"), name.alias("subject"))


def lost_conversations(rows: DataFrame, said: DataFrame, min_chars: int = 10, min_tokens: int = 50) -> DataFrame:
    """Exchanges of which no key term is in the summary."""
    w = Window.partitionBy("session_id", "event").orderBy("idx")
    t = rows.withColumns({"text": message_text(), "result": has_block("tool_result")})
    nxt = lambda c: F.lead(c).over(w)
    answered = F.coalesce((nxt("category") == "conversation") & (nxt("type") == "assistant"), F.lit(False))
    t = t.withColumns({"answered": answered, "n_tokens": nxt("tokens"), "n_idx": nxt("idx"), "n_text": nxt("text")})
    t = t.filter((F.col("category") == "conversation") & (F.col("type") == "user") & ~F.col("result") & (js_len(F.col("text")) >= min_chars))
    both = F.concat(F.col("text"), F.lit(" "), F.when(F.col("answered"), F.col("n_text")).otherwise(""))
    t = t.select("session_id", "event", "idx", "text", both.alias("both"), (F.col("tokens") + F.when(F.col("answered"), F.col("n_tokens")).otherwise(0)).alias("tokens"), F.when(F.col("answered"), F.col("n_idx")).otherwise(F.col("idx")).alias("last_idx"))
    j = t.filter(F.col("tokens") >= min_tokens).join(said, ["session_id", "event"])
    return j.filter(~_mentions(key_terms(F.col("both")), F.col("summary"))).select("session_id", "event", F.lit("conversation").alias("type"), F.col("idx").alias("first_idx"), "last_idx", "tokens", one_line(F.col("text"), 80).alias("subject"))


def lost_tool_results(rows: DataFrame, said: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Tool results whose tool and first words the summary does not mention."""
    t = rows.filter((F.col("category") == "tools") & (F.col("type") == "user") & has_block("tool_result") & (F.col("tokens") >= min_tokens))
    structured = F.get(F.filter(F.flatten(F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b: F.transform(b["sub"], lambda s: s["text"]))), lambda x: js_trim(x) != ""), F.lit(0))
    text = F.when(js_trim(message_text()) != "", message_text()).otherwise(F.coalesce(structured, F.lit("")))
    t = t.select("session_id", "event", "idx", "tokens", "tool_name", js_trim(one_line(text, 80)).alias("preview"))
    j = t.join(said, ["session_id", "event"])
    named = F.col("summary").contains(F.lower("tool_name")) | ((js_len(F.col("preview")) > 20) & F.col("summary").contains(F.lower(F.substring("preview", 1, 30))))
    return j.filter(~F.coalesce(named, F.lit(False))).select("session_id", "event", F.lit("tool_result").alias("type"), F.col("idx").alias("first_idx"), F.col("idx").alias("last_idx"), "tokens", F.coalesce("tool_name", F.lit("Tool")).alias("subject"))


def lost_instructions(rows: DataFrame, said: DataFrame, min_tokens: int = 20, min_chars: int = 10) -> DataFrame:
    """System and state messages of which no key term is in the summary."""
    t = rows.filter(F.col("category").isin("system", "state") & (F.col("tokens") >= min_tokens) & ~F.coalesce(F.col("subtype") == "compact_boundary", F.lit(False)) & ~F.coalesce("is_meta", F.lit(False)))
    t = t.select("session_id", "event", "idx", "tokens", message_text().alias("text")).filter(js_len(F.col("text")) >= min_chars)
    j = t.join(said, ["session_id", "event"])
    return j.filter(~_mentions(key_terms(F.col("text")), F.col("summary"))).select("session_id", "event", F.lit("instruction").alias("type"), F.col("idx").alias("first_idx"), F.col("idx").alias("last_idx"), "tokens", one_line(F.col("text"), 80).alias("subject"))


def lost_content(classified: DataFrame, messages: DataFrame, events: DataFrame) -> DataFrame:
    """All lost items of all events, largest first within an event."""
    numbered = event_windows(events)
    rows, said = window_rows(classified, numbered), summaries(messages, numbered)
    parts = [f(rows, said).select(*COLUMNS) for f in (lost_file_reads, lost_conversations, lost_tool_results, lost_instructions)]
    all_ = reduce(lambda a, b: a.unionByName(b), parts)
    order = F.array_position(F.array(*(F.lit(x) for x in ("file_read", "conversation", "tool_result", "instruction"))), F.col("type"))
    w = Window.partitionBy("session_id", "event").orderBy(F.desc("tokens"), order, "first_idx")
    return all_.withColumn("position", F.row_number().over(w).cast("bigint"))


def lost_totals(items: DataFrame) -> DataFrame:
    """Lost tokens and items by event, session and in all (null keys)."""
    return items.rollup("session_id", "event").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_items"))


#: Lengths of the starts by which short items are sought: the longest that fits counts.
GRAMS = (8, 4, 2, 1)
#: Hashes that a Python task holds before it hands them on.
HASHES = 1 << 19


def _gram_hashes(text: str, n: int, whole: bool):
    """Hashes of the text's first ``n`` characters, or of every run of ``n``, each once."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    places = len(codes) - n + 1 if whole else min(1, len(codes) - n + 1)
    if places < 1:
        return np.zeros(0, np.int64)
    h = np.full(places, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + places]
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def _gram_batches(batches, lengths: tuple[int, ...] | None, names: list[str]):
    """``_with_grams`` on Arrow batches. Texts have many times their bytes in hashes, so a batch is handed on
    whenever it has ``HASHES``; only a longer text has more."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        hs, ns, size, at = [], [], 0, 0
        for k, t in enumerate(b.column(b.num_columns - 1), 1):
            t = t.as_py()
            n = None if lengths else next((g for g in GRAMS if g <= len(t)), 0)
            hs.append(np.concatenate([_gram_hashes(t, g, True) for g in lengths]) if lengths else _gram_hashes(t, n, False))
            ns.append(n)
            size += len(hs[-1])
            if size >= HASHES or k == b.num_rows:
                part = b.slice(at, k - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hs, pa.list_(pa.int64())), pa.array(ns, pa.int32())], names)
                hs, ns, size, at = [], [], 0, k


def _with_grams(df: DataFrame, lengths: tuple[int, ...] | None) -> DataFrame:
    """``df`` (last column: text) with hs, the hashes of its runs of these lengths in place of the text; without
    lengths, of its start, and n, that start's length."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("hs", T.ArrayType(T.LongType())), T.StructField("n", T.IntegerType())])
    names = schema.names
    return df.mapInArrow(lambda batches: _gram_batches(batches, lengths, names), schema)


def surviving_items(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (item_id, doc_id): passages that a text contains whole.

    Both sides are keyed by a hash of what the item starts with, so the test runs on matching
    places only and never as a nested loop over all pairs: three words inside of an item of five words or
    more, else its first 8, 4, 2 or 1 characters, for which the texts are hashed at every place. The empty item
    is in no text. Items: (item_id, text); texts: (doc_id, text)."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    it = items.select("item_id", F.col("text").alias("item"), words(F.col("text")).alias("w")).filter(F.length("item") > 0).distinct()
    it = it.select("item_id", "item", F.xxhash64("item").alias("ik"), "w")
    key = F.xxhash64("text")
    # a long item's ends may be parts of words, so its key are three words inside
    long_ = it.filter(F.size("w") >= 5).select("item_id", "ik", F.xxhash64(F.slice("w", 2, 3)).alias("h"))
    short = _with_grams(it.filter(F.size("w") < 5).select("item_id", "ik", "item"), None).select("item_id", "ik", F.explode("hs").alias("h"), "n")
    kinds = tuple(sorted(r[0] for r in short.select("n").distinct().collect()))  # of GRAMS
    tx = texts.select("doc_id", key.alias("tk"), words(F.col("text")).alias("w"))
    runs = F.expr("array_distinct(CASE WHEN size(w) >= 3 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(slice(w, i + 1, 3))) ELSE array() END)")
    # hashes travel without the texts, which are joined once to the pairs that agree
    met = tx.select("doc_id", "tk", F.explode(runs).alias("h")).join(long_, "h").select("doc_id", "tk", "item_id", "ik")
    if kinds:
        at = _with_grams(texts.filter(F.col("text").isNotNull()).select("doc_id", key.alias("tk"), "text"), kinds)
        met = met.unionByName(at.select("doc_id", "tk", F.explode("hs").alias("h")).join(short.drop("n"), "h").select("doc_id", "tk", "item_id", "ik"))
    met = met.distinct()
    met = met.join(it.select(F.col("item_id").alias("i2"), F.col("ik").alias("k2"), "item"), F.col("item_id").eqNullSafe(F.col("i2")) & (F.col("ik") == F.col("k2")))
    src = texts.select(F.col("doc_id").alias("d2"), key.alias("t2"), "text")
    met = met.join(src, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tk") == F.col("t2")))
    return met.filter(F.col("text").contains(F.col("item"))).select("item_id", "doc_id").distinct()
