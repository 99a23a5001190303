"""Ordered functions over sessions that are longer than one task should read.

A window over a session is one task. Here a session is cut into blocks of ``block`` neighbouring
idx; each block is scanned by itself, one row for each block carries what it hands on, and only
those rows meet in a window of the session. A row then adds its block's carry to its own
result. Rows move once, by session and block. The results are those of the plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
_KEYS = ["session_id", "_block"]


def _within():
    return Window.partitionBy(*_KEYS).orderBy("idx")


def _across():
    return Window.partitionBy("session_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _blocks(df: DataFrame, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col("idx") / block).cast("bigint")).repartition(*_KEYS)


def running_sum(df: DataFrame, value: str | Column, out: str, block: int = BLOCK) -> DataFrame:
    """``out``: the sum of ``value`` over the session's rows up to each row."""
    rows = _blocks(df.withColumn("_v", F.col(value) if isinstance(value, str) else value), block)
    carry = rows.groupBy(*_KEYS).agg(F.sum("_v").alias("_sum")).withColumn("_carry", F.sum("_sum").over(_across())).select(*_KEYS, "_carry")
    own = rows.withColumn("_own", F.sum("_v").over(_within().rowsBetween(Window.unboundedPreceding, 0)))
    # a sum of nulls alone is null, as in a window
    total = F.when(F.col("_own").isNull(), F.col("_carry")).otherwise(F.col("_own") + F.coalesce("_carry", F.lit(0)))
    return own.join(carry, _KEYS).withColumn(out, total).drop("_v", "_own", "_carry", "_block")


def last_value(df: DataFrame, value: str | Column, out: str, block: int = BLOCK, before: bool = False) -> DataFrame:
    """``out``: the last value that is not null up to each row, or before it."""
    rows = _blocks(df.withColumn("_v", F.col(value) if isinstance(value, str) else value), block)
    last = rows.groupBy(*_KEYS).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("idx"))).alias("_last"))
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(_across())).select(*_KEYS, "_carry")
    own = F.last("_v", ignorenulls=True).over(_within().rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    return rows.withColumn("_own", own).join(carry, _KEYS).withColumn(out, F.coalesce("_own", "_carry")).drop("_v", "_own", "_carry", "_block")


def islands(df: DataFrame, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``out``: the number, from 1, of the run of equal values that each row is in; null counts as a value."""
    rows = last_value(df, F.struct(value), "_before", block, before=True)
    new = F.when(F.col("_before").isNotNull() & F.col(f"_before.{value}").eqNullSafe(F.col(value)), 0).otherwise(1)
    return running_sum(rows, new, out, block).drop("_before")


def moving_sum(df: DataFrame, value: str | Column, rows: int, out: str, block: int = BLOCK) -> DataFrame:
    """``out``: the sum of ``value`` over the ``rows`` rows before each row (idx counts without gaps);
    the last rows of a block are lent to the next one."""
    if rows > block:
        raise ValueError("a block must hold the rows that are summed")
    v = df.withColumn("_v", F.col(value) if isinstance(value, str) else value).withColumns({"_block": F.floor(F.col("idx") / block).cast("bigint"), "_lent": F.lit(False)})
    lent = v.filter(F.col("idx") % block >= block - rows).withColumns({"_block": F.col("_block") + 1, "_lent": F.lit(True)})
    both = v.unionByName(lent).repartition(*_KEYS)
    return both.withColumn(out, F.sum("_v").over(_within().rowsBetween(-rows, -1))).filter(~F.col("_lent")).drop("_v", "_lent", "_block")
