"""Exact length histogram: one row for each encoded length, with suffix sums.

Documents are counted by encoded length; sums over the lengths from one value
upward answer totals, quantiles and truncated totals at every context limit.

Edge cases: a null or empty text has length 0 and is counted. Repeated rows count
once each; equal lengths share a row. An empty table gives an empty histogram.
Null group values form a group of their own. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import count_tokens
from .store import cut

BLOCK = 1024  # lengths to a block: a block's rows and the list of blocks each fit a task


def histogram(lengths: DataFrame, length: str = "n_tokens", by: tuple[str, ...] = ()) -> DataFrame:
    """Documents by exact length and group; pre-aggregated before the one shuffle."""
    return lengths.groupBy(*by, F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each length L: documents and tokens at L or longer, totals, the share of
    documents up to L, and the tokens left when every document is cut at L.

    Sums run in two levels, inside blocks of lengths and over the blocks, so that no
    task sees more than a block's rows or one row for each block.
    """
    blocked = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inner = Window.partitionBy(*by, "block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocked.groupBy(*by, "block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = Window.partitionBy(*by).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    blocks = blocks.select(
        *(F.col(c).alias(f"b_{c}") for c in by),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("bd").over(whole).alias("total_docs"),
        F.sum("bt").over(whole).alias("total_tokens"),
    )
    on = F.col("block") == F.col("b_block")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    rows = blocked.select(*by, "n_tokens", "n_docs", "block", F.sum("n_docs").over(inner).alias("d"), F.sum("tokens").over(inner).alias("t")).join(blocks, on)
    docs_ge, tokens_ge = F.col("d") + F.col("docs_above"), F.col("t") + F.col("tokens_above")
    return rows.select(
        *by,
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - docs_ge + F.col("n_docs")) / F.col("total_docs")).alias("rank"),
        (F.col("total_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_tokens"),
    )


def token_length_histogram(docs: DataFrame, text: str = "text", by: tuple[str, ...] = (), **kw) -> DataFrame:
    # both levels of the sums read the histogram: it is written once, not encoded twice
    return suffix_sums(cut(histogram(count_tokens(docs, text, keep=by, **kw), by=by)), by)


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals at the given context limits: documents that fit and tokens when cut there."""
    over = [F.min(F.when(F.col("n_tokens") > int(x), F.struct("n_tokens", "docs_ge", "tokens_ge"))).alias(f"o{i}") for i, x in enumerate(limits)]
    one = sums.agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"), *over)
    rows = F.array(*(F.struct(F.lit(int(x)).cast("long").alias("context_limit"), F.col(f"o{i}").alias("o")) for i, x in enumerate(limits)))
    out = one.select("total_docs", "total_tokens", F.explode(rows).alias("r"))
    over_docs, over_tokens = F.coalesce(F.col("r.o.docs_ge"), F.lit(0)), F.coalesce(F.col("r.o.tokens_ge"), F.lit(0))
    return out.select(
        F.col("r.context_limit").alias("context_limit"),
        "total_docs",
        (F.col("total_docs") - over_docs).alias("docs_fitting"),
        (F.col("total_tokens") - over_tokens + F.col("r.context_limit") * over_docs).alias("truncated_tokens"),
    )


def quantile(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length whose share of documents reaches each wanted share."""
    picks = [F.min(F.when(F.col("rank") >= float(q), F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    one = sums.agg(*picks)
    pairs = F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)))
    return one.select(F.explode(pairs).alias("p")).select("p.share", "p.n_tokens")
