"""The analysis of growing sessions, batch by batch, without reading old messages again.

A batch becomes three small tables whose rows can be added up in any order: sums by category, tool
result and compaction; the last name of each tool call; and one row for each session (size, last
call, last human text). They are written below the batch's own id, so a batch that is run
again replaces what it wrote. From its predecessors a batch needs one row for each of its own
sessions. What later messages can change is kept apart instead of decided: a result waits
for its call's last name under the call's id, the last human text is a row that moves from its
other category, and the nine rows after a boundary stay single, as the live window begins at the
first call among them. ``fold`` adds old batches up.

The state gives the buckets that ``classify`` and ``buckets`` give over all messages, for
the whole session and from the last compaction on, whatever the batches were.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..operators import classify as C
from ..operators.tokens import effective_input
from ..sources.shared import cut, exists, free, remove, subfolders

NEAR = 9
_KEYS = ("session_id", "epoch", "near", "falls", "category", "result_id")
_PLACE = "epoch bigint, near bigint, falls bigint"
_SCHEMAS = {
    "sums": f"session_id string, {_PLACE}, category string, result_id string, tokens bigint, n bigint, n_estimated bigint, calls bigint, eff struct<idx:bigint,eff:bigint>",
    "names": "session_id string, id string, last struct<idx:bigint,pos:int,name:string>",
    "sessions": f"session_id string, n bigint, boundaries bigint, falls bigint, boundary bigint, call struct<idx:bigint,eff:bigint>, human struct<idx:bigint,tokens:bigint,other:string,marker:boolean,epoch:bigint,near:bigint,falls:bigint>, most bigint, model struct<idx:bigint,model:string>",
}


def _added(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with one row for each key: their rows added up."""
    s, n, o = parts["sums"], parts["names"], parts["sessions"]
    return {
        "sums": s.groupBy(*_KEYS).agg(*(F.sum(c).alias(c) for c in ("tokens", "n", "n_estimated", "calls")), F.max("eff").alias("eff")),
        "names": n.groupBy("session_id", "id").agg(F.max("last").alias("last")),
        "sessions": o.groupBy("session_id").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("boundaries", "falls", "boundary", "call", "human", "most", "model"))),
    }


def _read(spark: SparkSession, base: str, before: int | None = None) -> dict[str, DataFrame]:
    """All batches (or those before one): the last fold and what came after it."""
    done = [k for k in subfolders(spark, f"{base}/folded") if exists(spark, f"{base}/folded/{k}/sessions/_SUCCESS") and (before is None or k < before)]
    upto = max(done, default=-1)
    ids = [k for k in subfolders(spark, f"{base}/batches") if k > upto and (before is None or k < before)]
    paths = [f"{base}/batches/{k}" for k in ids] + ([f"{base}/folded/{upto}"] if done else [])
    return {t: spark.read.schema(schema).parquet(*(f"{p}/{t}" for p in paths)) if paths else spark.createDataFrame([], schema) for t, schema in _SCHEMAS.items()}


def _write(parts: dict[str, DataFrame], to: str) -> None:
    for t in _SCHEMAS:  # sessions last: its mark says that all are there
        parts[t].write.mode("overwrite").parquet(f"{to}/{t}")


def delta(messages: DataFrame, known: DataFrame, drop: int = S.COMPACTION_DROP) -> dict[str, DataFrame]:
    """The three tables of new message rows (session_id, line_no, ...), and the rows that were written for them;
    ``known`` are the sessions so far."""
    w = Window.partitionBy("session_id").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    k = known.select(F.col("session_id").alias("k_s"), F.col("n").alias("k_n"), F.col("boundaries").alias("k_b"), F.col("falls").alias("k_f"), F.col("boundary").alias("k_at"), F.col("call").alias("k_call"))
    m = messages.withColumn("session_id", F.col("session_id").cast("string")).join(k, F.col("session_id") == F.col("k_s"), "left")
    m = m.withColumn("idx", F.coalesce("k_n", F.lit(0)) + F.row_number().over(w) - 1)
    m = C.row_marks(m)
    boundary = F.coalesce((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"), F.lit(False))
    eff = effective_input()
    call = F.when((F.col("type") == "assistant") & F.col("usage").isNotNull(), F.struct("idx", eff.alias("eff")))
    m = m.withColumns({"_b": boundary, "_c": call})
    prev = F.coalesce(F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("k_call"))
    m = m.withColumn("_fell", F.col("_c").isNotNull() & F.coalesce(prev["eff"] - F.col("_c.eff") > drop, F.lit(False)))
    m = m.withColumns(
        {
            "epoch": F.coalesce("k_b", F.lit(0)) + F.sum(F.col("_b").cast("bigint")).over(upto),
            "falls": F.coalesce("k_f", F.lit(0)) + F.sum(F.col("_fell").cast("bigint")).over(upto),
            "_at": F.coalesce(F.max(F.when(F.col("_b"), F.col("idx"))).over(upto), F.col("k_at")),
        }
    )
    off = F.col("idx") - F.col("_at")
    m = m.withColumn("near", F.when(off <= NEAR, off).otherwise(F.lit(None)).cast("bigint"))
    result = F.col("_result").isNotNull() & ~F.col("_marker") & ~F.col("_is_call")
    real = (F.col("type") == "assistant") & ~F.coalesce(F.col("model") == S.SYNTHETIC, F.lit(False)) & (eff > 0)
    named = (F.col("type") == "assistant") & F.col("model").isNotNull() & (F.col("model") != S.SYNTHETIC)
    category = F.when(F.col("_marker"), "system").when(F.col("_is_call"), C.tool_category(F.col("_call"))).when(~result, F.col("_other"))
    m = cut(
        m.select(
            "session_id", "idx", "epoch", "near", "falls", "blocks", "type", "_human", "_marker", "_other", "tokens", "_c", "_at",
            category.alias("category"),
            F.when(result, F.coalesce("_result.tool_use_id", F.lit(""))).alias("result_id"),
            (F.col("accuracy") == "estimated").alias("estimated"),
            F.when(real, F.struct("idx", eff.alias("eff"))).alias("eff"),
            F.when(F.col("type").isNotNull(), eff).alias("any_eff"),
            F.when(named, F.struct("idx", "model")).alias("named"),
        )
    )
    sums = m.groupBy(*_KEYS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.sum(F.col("estimated").cast("bigint")).alias("n_estimated"), F.count("_c").alias("calls"), F.max("eff").alias("eff"))
    names = C.tool_uses(m).filter("id <> '' AND name <> ''").groupBy("session_id", "id").agg(F.max(F.struct("idx", "pos", "name")).alias("last"))
    human = F.struct("idx", "tokens", F.col("_other").alias("other"), F.col("_marker").alias("marker"), "epoch", "near", "falls")
    sessions = m.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("epoch").alias("boundaries"), F.max("falls").alias("falls"), F.max("_at").alias("boundary"), F.max("_c").alias("call"),
        F.max_by(human, F.when(F.col("_human"), F.col("idx"))).alias("human"), F.max("any_eff").alias("most"), F.max("named").alias("model"),
    )
    return {"sums": sums, "names": names, "sessions": sessions, "rows": m}


@dataclass
class State:
    #: (session_id, category, tokens, n_messages, accuracy, percentage) of whole sessions, and of compacted ones since
    buckets: DataFrame
    current: DataFrame
    #: (session_id, n, n_compactions, effective, context_limit, signal)
    sessions: DataFrame


class Incremental:
    """The state below ``base``, a folder that all executors share."""

    def __init__(self, base: str, fold_every: int = 50):
        self.base, self.fold_every = base.rstrip("/"), fold_every

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch; for ``foreachBatch``."""
        spark = batch.sparkSession
        known = _added(_read(spark, self.base, batch_id))["sessions"]
        parts = delta(batch, known)
        _write(parts, f"{self.base}/batches/{batch_id}")
        free(parts["rows"])
        if (batch_id + 1) % self.fold_every == 0:
            self.fold(spark, batch_id)

    def fold(self, spark: SparkSession, upto: int) -> None:
        """Add up the batches to ``upto``; those that an earlier fold holds are deleted."""
        old = [k for k in subfolders(spark, f"{self.base}/folded") if k < upto]
        _write(_added(_read(spark, self.base, upto + 1)), f"{self.base}/folded/{upto}")
        for k in subfolders(spark, f"{self.base}/batches"):
            if k <= max(old, default=-1):
                remove(spark, f"{self.base}/batches/{k}")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Start the stream of message rows that keeps the state up to date; drains what is there."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def state(self, spark: SparkSession) -> State:
        from ..functions.text import DEFAULT_LIMIT, LONG_LIMIT, context_limit

        parts = _added(_read(spark, self.base))
        o = parts["sessions"]
        names = parts["names"].select(F.col("session_id").alias("n_s"), F.col("id").alias("n_id"), F.col("last.name").alias("name"))
        sums = parts["sums"].join(names, (F.col("session_id") == F.col("n_s")) & (F.col("result_id") == F.col("n_id")), "left")
        sums = sums.withColumn("category", F.coalesce("category", C.tool_category(F.col("name"))))
        # the last human text leaves its other category for the user's
        h = o.filter("human IS NOT NULL AND NOT human.marker").select("session_id", "human.*")
        moves = [h.select("session_id", "epoch", "near", "falls", category.alias("category"), (F.col("tokens") * sign).alias("tokens"), F.lit(sign).alias("n"), F.lit(sign).alias("n_estimated")) for category, sign in ((F.col("other"), -1), (F.lit("user"), 1))]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sums.select("session_id", "epoch", "near", "falls", "category", "tokens", "n", "n_estimated"), *moves])
        last = o.select("session_id", F.col("boundaries").alias("last_epoch"), F.col("falls").alias("last_fall"))
        starts = parts["sums"].filter("calls > 0 AND near >= 1").join(last, "session_id").filter("epoch = last_epoch").groupBy("session_id").agg(F.min("near").alias("first_call"))
        # the nine rows after the last boundary begin with its first call, or the next row
        last = last.join(starts, "session_id", "left").withColumn("first_call", F.coalesce("first_call", F.lit(1)))

        def live(df: DataFrame) -> DataFrame:
            at = df.join(last, "session_id")
            after = (F.col("epoch") == F.col("last_epoch")) & (F.col("near").isNull() | (F.col("near") >= F.col("first_call")))
            return at.filter(F.when(F.col("last_epoch") > 0, after).otherwise(F.col("falls") == F.col("last_fall")))

        effective = live(parts["sums"]).groupBy("session_id").agg(F.max("eff").alias("eff"))
        long_model = context_limit(F.coalesce("model.model", F.lit(""))) == LONG_LIMIT
        over = F.coalesce(F.col("most") > DEFAULT_LIMIT, F.lit(False))
        sessions = o.join(effective, "session_id", "left").select(
            "session_id", "n", F.when(F.col("boundaries") > 0, F.col("boundaries")).otherwise(F.col("falls")).alias("n_compactions"), F.col("eff.eff").alias("effective"),
            F.when(long_model | over, LONG_LIMIT).otherwise(DEFAULT_LIMIT).cast("bigint").alias("context_limit"),
            F.when(long_model, "model-id").when(over, "usage").otherwise("default").alias("signal"),
        )
        compacted = last.filter("last_epoch > 0 OR last_fall > 0").select("session_id")
        return State(C.bucket_rows(rows), C.bucket_rows(live(rows).join(compacted, "session_id", "left_semi")), sessions)
