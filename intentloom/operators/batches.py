"""Evaluation batches over a shuffled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions.order import DEFAULT_SEED, seeded_key
from intentloom.operators.rank import class_rank


def eval_batches(df: DataFrame, batch_size: int, key: str = "uid", salt: str = "batch",
                 seed: int = DEFAULT_SEED, by=()) -> DataFrame:
    """Cut the table, in seeded random order, into batches of
    ``batch_size`` rows: ``batch = (rn - 1) div batch_size`` (0-based)."""
    x = df.withColumn("__h", seeded_key(key, salt=salt, seed=seed))
    r = class_rank(x, list(by), "__h", key, out="rn").drop("__h")
    return r.withColumn("batch", F.floor((F.col("rn") - 1).cast("double") / F.lit(float(batch_size))).cast("long"))
