"""The corpus pipeline: quality, lines, near-duplicates, benchmark leaks, encoding.

Each stage reads the documents that its predecessor kept and returns the columns of
``documents``; the last returns the token ids. ``run`` writes every stage's result to the
shared folder and reads it back.

For every stage: an empty table gives an empty one; repeated rows are treated alike; further
columns pass through (the last stage leaves them out), whatever their names; a very long text
is worked on whole by one task. What each does with nulls, empty texts and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, line_dedup, minhash, quality
from sparkloom.llm.store import column, cut


def _apart(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the other columns are packed away, so that no name of a stage clashes."""
    return docs.select(F.struct(*(column(c) for c in docs.columns if c != "text")).alias("row"), "doc_id", "text")


def _together(done: DataFrame, columns: list[str], text, changed) -> DataFrame:
    """The columns of the documents, with the new text and its length where it changed."""

    def one(c: str):
        if c == "text":
            return F.when(changed, text).otherwise(F.col("text"))
        old = F.col("row")[c]
        return F.when(changed, F.length(text).cast("long")).otherwise(old) if c == "n_chars" else old

    return done.select(*(one(c).alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that fail a rule are removed from the others.

    A null or empty text has no words and is rejected. Documents are judged one by one, so there are
    no ties; n_chars follows a changed text."""
    done = quality.clean(_apart(docs)).filter("kept")
    return _together(done, docs.columns, F.col("cleaned"), F.col("n_lines_removed") > 0)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them only.

    A null text stays null; a document that loses all its lines keeps an empty text. The largest
    doc_id decides, so there are no ties; rows with a null doc_id lose lines but do not count."""
    done = line_dedup.dedup_lines(_apart(docs))
    return _together(done, docs.columns, F.col("deduped"), F.col("n_dropped") > 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the least id.

    Rows with a null id or text stay. Texts without words are copies of each other. Repeated rows
    of the document that stays all stay."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay. Each row goes by its own id and text."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, and whether they decode to the same bytes.

    A null text is encoded as the empty one: no ids."""
    marked = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    done = bpe.round_trip(marked)
    return done.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", encode),
]

#: Near-duplicate classes and byte-pair merges have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
