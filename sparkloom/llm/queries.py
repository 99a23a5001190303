"""The registered queries of the subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, langid, license_scan, line_dedup, minhash, passage_quality, quality, token_counts, turn_repair, warc, word_lm


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of ``documents`` for each source, with suffix sums."""
    return token_counts.token_length_histogram(_table(spark, sf_dir, "documents"), by=("source",))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; four fifths of the ids may be learned from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line-first verdict for every document."""
    done = quality.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.drop("text", "cleaned")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target are the documents labelled good."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return word_lm.score(docs, good)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items with a verified overlap."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, license labels and a score for every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after deduplication, and a digest of what stays, for every document."""
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("deduped").cast("binary"), 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs)
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive."""
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage by a hash."""
    original = _table(spark, sf_dir, "conversations")
    return turn_repair.report(original, turn_repair.damage(original))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, exact distance and inertia of every usable vector."""
    return centroids.report(_table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; four fifths of the ids may be learned from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = passage_quality.fit(docs, labels.filter(passage_quality.learn_from(F.col("doc_id"))))
    return passage_quality.predict(docs, model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_warc": op10_warc,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality.oracle(),
    "op5_decontamination": decontaminate.oracle(),
    "op6_license_scan": license_scan.oracle(),
    "op7_line_dedup": line_dedup.oracle(),
    "op10_warc": warc.oracle(),
    "op11_conversation_repair": turn_repair.oracle(),
    "op12_centroid_clustering": centroids.oracle(),
}
