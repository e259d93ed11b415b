"""Canonical views over the given parquet tables.

Canonical utterances: ``(uid BIGINT, utterance STRING, label STRING, ord BIGINT)``;
``ord`` is the arrival order the reference keeps implicitly in list position.
Only the needed columns are selected so the parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentloom.functions.order import hash_int
from intentloom.functions.text import blank_tokens
from intentloom.session import cores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread rows over the cores when the scan is too narrow.

    A file with one row group is read by one task, and per-token work before
    the first shuffle would then run on one core.  Only in that case are the
    rows hash-partitioned on ``key`` (deterministic, so retries see the same
    rows); a wide scan (many files or row groups, any real cluster input) is
    left untouched.  Filters and column pruning still reach the scan.
    """
    n = cores(df.sparkSession)
    try:
        parts = df.rdd.getNumPartitions()
    except Exception:  # e.g. a Spark Connect session: leave the plan as it is
        return df
    if parts >= n:
        return df
    return df.repartition(n, key)


def utt(spark, d) -> DataFrame:
    """documents as labelled utterances: label = source."""
    return spread(table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("uid"), F.col("text").alias("utterance"),
        F.col("source").alias("label"), F.col("doc_id").alias("ord"))


def utt_lang(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("uid"), F.col("text").alias("utterance"),
        F.col("lang").alias("label"), F.col("doc_id").alias("ord"))


def part_utt(spark, d) -> DataFrame:
    """part names as utterances, part type as label (many conflicting copies)."""
    return spread(table(spark, d, "part"), "p_partkey").select(
        F.col("p_partkey").alias("uid"), F.col("p_name").alias("utterance"),
        F.col("p_type").alias("label"), F.col("p_partkey").alias("ord"))


TURNS = 1 << 32


def conv(spark, d) -> DataFrame:
    """conversation turns: label = role, uid = conv_id * 2**32 + turn (a turn is 32 bits)."""
    return spread(table(spark, d, "conversations"), "conv_id").select(
        (F.col("conv_id").cast("long") * TURNS + F.col("turn")).alias("uid"), F.col("text").alias("utterance"),
        F.col("role").alias("label"), (F.col("conv_id").cast("long") * TURNS + F.col("turn")).alias("ord"))


def vec(spark, d) -> DataFrame:
    """embeddings: ``(uid, label STRING, vec ARRAY<FLOAT>)``."""
    return spread(table(spark, d, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("uid"), F.col("label").cast("string").alias("label"),
        F.col("embedding").alias("vec"))


def vec_heads(spark, d, heads: int = 4, width: int = 16) -> DataFrame:
    """embeddings cut into ``heads`` head vectors: ``heads ARRAY<ARRAY<FLOAT>>``."""
    return vec(spark, d).select(
        "uid", "label",
        F.transform(F.sequence(F.lit(0), F.lit(heads - 1)),
                    lambda h: F.slice(F.col("vec"), h * width + 1, width)).alias("heads"))


def lab(spark, d) -> DataFrame:
    """documents left-joined to labels (nulls where unlabelled)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    labels = table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left")


def bench(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("uid"), F.col("text").alias("utterance"))


def tok_vec(spark, d) -> DataFrame:
    """A word-vector table ``(word, vec)`` for the tokens of part names.

    Each distinct token gets the embedding row ``md5 bucket % count(embeddings)``.
    """
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = emb.select(F.count(F.lit(1))).scalar()
    words = (table(spark, d, "part").select(F.explode(blank_tokens("p_name")).alias("word"))
             .where(F.col("word") != "").distinct())
    return (words.withColumn("vec_id", hash_int("word") % n)
            .join(emb, "vec_id").select("word", F.col("embedding").alias("vec")))
