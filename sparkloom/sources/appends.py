"""Append-only logs of JSON lines: every run once, read by many tasks, folded to the newest records.

A run is written below its own number and ends with a mark; a run that is complete is not written again,
and one that is not is replaced, so an append that is repeated adds nothing. Lines have an order:
by run, file and place in the file. A fold keeps one record for each key and takes the place of the
runs it read, which stay until the next fold, for those who still read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import exists, remove, subfolders


def ordered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (line, value) of text files; ``line`` orders them as they stand. Files are split like any text."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(paths).select(place.alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


class AppendLog:
    """The log below ``base``."""

    def __init__(self, base: str):
        self.base = base.rstrip("/")

    def append(self, rows: DataFrame, run: int, *order: str | Column) -> bool:
        """Write the rows of one run, in this order; False if that run is there already, folded or not."""
        spark = rows.sparkSession
        if run <= max(self._folds(spark), default=-1) or exists(spark, f"{self.base}/runs/{run}/_SUCCESS"):
            return False
        (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(f"{self.base}/runs/{run}")
        return True

    def _folds(self, spark: SparkSession) -> list[int]:
        return [k for k in subfolders(spark, f"{self.base}/folded") if exists(spark, f"{self.base}/folded/{k}/_SUCCESS")]

    def lines(self, spark: SparkSession) -> DataFrame:
        """Rows (line, value): the last fold and the complete runs after it."""
        upto = max(self._folds(spark), default=None)
        runs = [k for k in subfolders(spark, f"{self.base}/runs") if (upto is None or k > upto) and exists(spark, f"{self.base}/runs/{k}/_SUCCESS")]
        paths = ([f"{self.base}/folded/{upto}"] if upto is not None else []) + [f"{self.base}/runs/{k}" for k in runs]
        if not paths:
            return spark.createDataFrame([], "line struct<run:bigint,file:string,start:bigint,row:bigint>, value string")
        run = F.regexp_extract("line.file", r"/(\d+)/[^/]+$", 1).cast("bigint")
        return ordered_lines(spark, paths).select(F.struct(run.alias("run"), "line.*").alias("line"), "value")

    def fold(self, spark: SparkSession, upto: int, key: str, newest: str) -> None:
        """Keep for each value of the field ``key`` the record with the largest ``newest`` (of equal ones the first line)
        of all runs to ``upto``. Lines without the key go."""
        done = self._folds(spark)
        if upto in done:
            return
        rows = self.lines(spark).filter(F.col("line.run") <= upto)
        rows = rows.withColumns({"k": F.get_json_object("value", f"$.{key}"), "t": F.get_json_object("value", f"$.{newest}")}).filter("k IS NOT NULL")
        first = F.row_number().over(Window.partitionBy("k").orderBy(F.desc_nulls_last("t"), "line"))
        rows.withColumn("r", first).filter("r = 1").orderBy("line").select("value").write.mode("overwrite").text(f"{self.base}/folded/{upto}")
        for k in subfolders(spark, f"{self.base}/runs"):
            if k <= max(done, default=-1):
                remove(spark, f"{self.base}/runs/{k}")
