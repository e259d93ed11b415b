"""Sinks: split sets and sweeps as partitioned tables.

Parts, K, sweep steps and folds are partition columns, never string paths
(so a missing slash cannot send rows to the wrong folder), and a reader that
asks for one part prunes the others.  A dynamic overwrite replaces only the
partitions being written; ``dynamic=False`` clears the target first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentloom.functions.order import hash_int
from intentloom.sources.exporters import TSV_OPTS


def write_split(split: DataFrame, path: str, fmt: str = "parquet", partition_by=("part", "k"),
                dynamic: bool = True) -> None:
    """Write a split (or sweep) partitioned by ``partition_by``."""
    if fmt not in ("parquet", "tsv"):
        raise ValueError(fmt)
    rows = split if fmt == "parquet" else split.select(*partition_by, "label", "utterance")
    # an option of this writer, not of the session: a later full rewrite clears the target
    w = rows.write.mode("overwrite").partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.options(**TSV_OPTS).csv(path)


def read_split(spark: SparkSession, path: str, part: str | None = None, k: int | None = None) -> DataFrame:
    """Read a written split; ``test_joint`` / ``support_joint`` are unions of
    two partitions, resolved by the filter."""
    df = spark.read.parquet(path)
    if part == "test_joint":
        df = df.where(F.col("part").isin("test_seen", "test_novel"))
    elif part == "support_joint":
        df = df.where(F.col("part").isin("support_seen", "support_novel"))
    elif part is not None:
        df = df.where(F.col("part") == part)
    if k is not None:
        df = df.where(F.col("k") == k)
    return df


def write_folds(df: DataFrame, path: str, folds: int = 10, key: str = "uid") -> None:
    """S9 export: rows spread over ``fold=1..folds`` folders by a stable hash."""
    (df.withColumn("fold", (hash_int(key) % folds + 1).cast("int"))
     .select("label", "utterance", "fold").write.mode("overwrite").partitionBy("fold")
     .options(**TSV_OPTS).csv(path))
