"""Entailment pairs: every utterance against every candidate label of its
subset, capped negative sampling, and the training-set modes.

Pairs carry the row key, never the text: texts (up to 20,000 words) are joined
back only where an encoder needs them, after sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions.order import DEFAULT_SEED, seeded_key
from intentloom.operators.joins import candidate_blocks, each_candidate
from intentloom.operators.rank import keep_smallest


def entailment_pairs(df: DataFrame, scope: str = "origin", key: str = "uid",
                     label: str = "label", carry=(), candidates: DataFrame | None = None,
                     label_cols=None, block_bytes: int | None = None) -> DataFrame:
    """``(key, scope, label_name, label INT)`` for each row and each
    distinct label of the same ``scope``; label = 1 where they are equal.
    ``carry`` columns of the row are copied into each of its pairs.  With
    ``candidates`` the labels come from that table instead (inference: the
    support set of the evaluation scope).

    ``label_cols`` (name -> Column of ``label_name``) are computed once per
    candidate label and copied into its pairs.

    The candidates travel as arrays of bounded bytes and each row explodes its
    scope's labels (a generator, no join, no shuffle of the rows).
    """
    src = df if candidates is None else candidates
    cands = src.select(scope, F.col(label).alias("label_name")).where(F.col("label_name").isNotNull()).distinct()
    extra = dict(label_cols or {})
    cands = cands.withColumns(extra) if extra else cands
    carry = list(carry)
    rows = df.select(key, scope, F.col(label).alias("__truth"), *carry)
    j = each_candidate(rows, candidate_blocks(cands, cands.columns, block_bytes),
                       lambda a: F.filter(a, lambda c: c[scope] == F.col(scope)),
                       lambda x: x.select(key, scope, "__truth", *carry, *[F.col(f"__c.{c}").alias(c) for c in ("label_name", *extra)]))
    return j.select(key, scope, "label_name",
                    F.coalesce((F.col("__truth") == F.col("label_name")).cast("int"), F.lit(0)).alias("label"),
                    *carry, *extra)


def entailment_positives(df: DataFrame, scope: str = "origin", key: str = "uid", label: str = "label", carry=()) -> DataFrame:
    """The pairs of ``entailment_pairs(df)`` with label 1: one per labelled row, without generating the others."""
    rows = df.where(F.col(label).isNotNull() & F.col(scope).isNotNull())
    return rows.select(key, scope, F.col(label).alias("label_name"), F.lit(1).alias("label"), *carry)


def sample_negatives(pairs: DataFrame, ratio: int = 2, key: str = "uid", seed: int = DEFAULT_SEED,
                     positives: DataFrame | None = None) -> DataFrame:
    """All positives plus ``least(ratio * n_pos, n_neg)`` negatives drawn in
    seeded random order (exact count; only pairs near the cut are ranked).

    ``positives`` (``entailment_positives``) spares two passes over all pairs."""
    pos = pairs.where(F.col("label") == 1) if positives is None else positives.select(*pairs.columns)
    neg = pairs.where(F.col("label") == 0)
    h = neg.withColumn("__h", seeded_key(key, "label_name", salt="neg", seed=seed))
    take = pos.select((F.count(F.lit(1)) * F.lit(ratio)).alias("take")).scalar()
    return pos.unionByName(keep_smallest(h, "__h", [key, "label_name"], take).drop("__h"))


def train_mode(train_pairs: DataFrame, support_pairs: DataFrame, num_shots: int,
               seen_class_data: str = "yes") -> DataFrame:
    """The training table: sampled seen pairs plus support pairs
    ('yes'), support pairs only ('no'), or seen pairs only (no shots)."""
    if num_shots and seen_class_data == "yes":
        return train_pairs.unionByName(support_pairs)
    if num_shots and seen_class_data == "no":
        return support_pairs
    return train_pairs
