"""Connected components of an edge list, as joins and aggregates.

Edges (a, b) with a <> b are long ids. Large-star and small-star steps alternate until
every id hangs from one root; each round is written to the shared folder. The state is the
edge list itself, never larger than the input, and nothing is collected.

A vertex may have any number of edges: its least neighbour is found by partial minima, and
written before the join, so that the join reads plain shuffles and a hub's rows can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, free


def _moved(down: DataFrame, least: DataFrame) -> DataFrame:
    return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = cut(_moved(both.filter("v > u"), least).distinct())
    free(least)
    return out


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    out = cut(_moved(down, least).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    free(least)
    return out


def _settled(e: DataFrame) -> bool:
    """Whether each id has one edge to a root, and no root has an edge to another."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(e.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    seen = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return seen.filter("up > 1 OR (up = 1 AND root = 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (id, root) for every id on an edge except the roots; root is the least id."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(max_rounds):
        if _settled(e):
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        wide = _large_star(e)
        free(e)
        e = _small_star(wide)
        free(wide)
    raise RuntimeError("components did not settle")
