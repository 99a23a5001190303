"""Token estimates and previews of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN_TEXT, absent_if_empty, divisor, js_len, one_line, tokens_of

_LENGTHS = ("text", "thinking", "signature", "input_json", "id", "tool_use_id", "name")


def _sample(b: Column) -> Column:
    """The text whose kind decides a block's divisor."""
    return F.coalesce(absent_if_empty(b["text"]), b["input_json"], absent_if_empty(b["content_str"]))


def _ceil_tokens(chars: Column, sample: Column) -> Column:
    return F.ceil(chars / divisor(sample)).cast("bigint")


def _own_chars(b: Column) -> Column:
    total = js_len(b["content_str"])
    for f in _LENGTHS:
        total = total + js_len(b[f])
    return total


def block_tokens(b: Column) -> Column:
    """Tokens of a content block; nested blocks are counted first, each by its own divisor."""
    def nested(s: Column) -> Column:
        return _ceil_tokens(_own_chars(s) + js_len(s["sub_json"]), _sample(s))

    inner = F.aggregate(b["sub"], F.lit(0).cast("bigint"), lambda a, s: a + nested(s))
    chars = _own_chars(b) + F.coalesce(inner, F.lit(0)) * F.lit(CHARS_PER_TOKEN_TEXT)
    return _ceil_tokens(chars, _sample(b))


def content_tokens(m: str = "") -> Column:
    c = lambda n: F.col(f"{m}{n}")
    of_blocks = F.aggregate(c("blocks"), F.lit(0).cast("bigint"), lambda a, b: a + block_tokens(b))
    return F.coalesce(F.when(c("content_kind") == "string", tokens_of(c("content_str"))).when(c("content_kind") == "array", of_blocks), F.lit(0)).cast("bigint")


def with_tokens(messages: DataFrame) -> DataFrame:
    """``messages`` with tokens and accuracy: an assistant's own output count is exact."""
    out = F.col("usage.output_tokens")
    exact = F.coalesce((F.col("type") == "assistant") & (out > 0), F.lit(False))
    return messages.withColumns({"tokens": F.when(exact, out).otherwise(content_tokens()), "accuracy": F.when(exact, "exact").otherwise("estimated")})


def effective_input() -> Column:
    """All input tokens of a call; null without usage."""
    u = F.col("usage")
    return u["input_tokens"] + F.coalesce(u["cache_creation_input_tokens"], F.lit(0)) + F.coalesce(u["cache_read_input_tokens"], F.lit(0))


def preview(max_len: int = 60) -> Column:
    """One line that shows what a message holds."""
    shown = F.filter(
        "blocks",
        lambda b: ((b["type"] == "text") & (F.length(b["text"]) > 0)) | ((b["type"] == "tool_use") & (F.length(b["name"]) > 0)) | (b["type"] == "tool_result") | (b["type"] == "thinking"),
    )
    b = F.get(shown, F.lit(0))
    block = (
        F.when(b["type"] == "text", one_line(b["text"], max_len))
        .when(b["type"] == "tool_use", F.concat(b["name"], F.lit("("), F.coalesce(F.substring(b["input_json"], 1, 30), F.lit("")), F.lit("...)")))
        .when(b["type"] == "tool_result", F.concat(F.lit("result: "), F.when(b["content_kind"] == "string", one_line(b["content_str"], max_len)).otherwise("[structured result]")))
        .when(b["type"] == "thinking", F.lit("[thinking]"))
        .otherwise(F.concat(F.lit("["), F.size("blocks").cast("string"), F.lit(" blocks]")))
    )
    no_content = F.when(F.length("subtype") > 0, F.concat(F.lit("[system: "), F.col("subtype"), F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("type"), F.lit("]")))
    return F.when((F.col("content_kind") == "string") & (F.length("content_str") > 0), one_line(F.col("content_str"), max_len)).when(F.col("content_kind") == "array", block).otherwise(no_content)


def message_text() -> Column:
    """A message's text: the string, or all text, thinking and string results joined by spaces."""
    parts = F.flatten(F.transform("blocks", lambda b: F.array_compact(F.array(*(absent_if_empty(b[f]) for f in ("text", "thinking", "content_str"))))))
    return F.coalesce(F.when(F.col("content_kind") == "string", F.col("content_str")).when(F.col("content_kind") == "array", F.array_join(parts, " ")), F.lit(""))
