"""Label dictionary work: distinct labels, dedup, ids, seen/novel choice.

Label tables hold one row per label.  Joins to them are broadcast behind a
row count (``joins.checked_broadcast``, or ``sized_broadcast`` when the label
count is already known); the remaining semi/anti joins are left to AQE, which
broadcasts from the measured size of the aggregate that makes the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions.order import DEFAULT_SEED, seeded_key
from intentloom.functions.text import norm_label
from intentloom.operators.joins import checked_broadcast, sized_broadcast
from intentloom.operators.rank import small_rank


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """A1: sorted distinct labels (order is given by ``label_ids``)."""
    return df.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()


def label_union(*dfs: DataFrame, label: str = "label") -> DataFrame:
    """Distinct union of the label columns of several tables."""
    out = None
    for d in dfs:
        s = d.select(F.col(label).alias("label"))
        out = s if out is None else out.unionByName(s)
    return out.distinct()


def label_except(all_labels: DataFrame, minus: DataFrame) -> DataFrame:
    """Labels of ``all_labels`` not in ``minus`` (left anti join)."""
    return all_labels.select("label").join(minus.select("label"), "label", "left_anti")


def dedup_last_wins(df: DataFrame, ids: DataFrame | None = None, n_labels: int | None = None) -> DataFrame:
    """A2: one row per utterance; the label of its *last* occurrence, the
    position (ord, uid) of its *first*.

    Partial aggregation runs before the shuffle, so a text copied a billion
    times sends one row per task, not a billion.  Labels travel as dense int
    ids (a size-checked broadcast of the label table) so every aggregate
    buffer is fixed-width and Spark plans a hash aggregate: the texts are
    hashed, never sorted.  A 64-bit text hash leads the key; grouping stays
    exact because the text is in the key too.
    """
    if ids is None:
        ids = label_ids(distinct_labels(df))
    if n_labels is not None:  # one row per label, count known
        ib = sized_broadcast(ids.select("label", "label_id"), n_labels)
    else:
        ib = checked_broadcast(ids.select("label", "label_id"))
    x = df.join(ib, "label", "left")
    g = (x.groupBy(F.xxhash64("utterance").alias("__th"), "utterance")
         .agg(F.min_by("uid", "ord").alias("uid"),
              F.max_by("label_id", "ord").alias("label_id"),
              F.min("ord").alias("ord")))
    return g.join(ib, "label_id", "left").select("uid", "utterance", "label", "ord")


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """A3/A5: rows per label."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def min_class_size(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """A4: drop all rows of labels with fewer than ``min_rows`` rows."""
    keep = class_sizes(df).where(F.col("n") >= min_rows).select("label")
    return df.join(keep, "label", "left_semi")


def label_ids(labels: DataFrame) -> DataFrame:
    """Dense 0-based ids in sorted label order: ``(label, label_id INT)``."""
    return small_rank(labels.select("label").distinct(), [F.col("label")], "label_id") \
        .select("label", (F.col("label_id") - 1).cast("int").alias("label_id"))


def lookup_ids(df: DataFrame, ids: DataFrame, label: str = "label", how: str = "left") -> DataFrame:
    """Attach ``label_id``; with ``how='left'`` unknown labels keep a NULL id."""
    return df.join(ids.withColumnRenamed("label", label), label, how)


def reverse_lookup(df: DataFrame, ids: DataFrame, id_col: str = "label_id", out: str = "label") -> DataFrame:
    """Id -> name."""
    r = ids.select(F.col("label_id").alias(id_col), F.col("label").alias(out))
    return df.join(r, id_col, "left")


def known_labels(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """keep rows whose label is in the dictionary (left semi join)."""
    return df.join(labels.select(F.col("label").alias(label)), label, "left_semi")


def choose_novel(labels: DataFrame, pct: int | None = 33, m: int | None = None,
                 seed: int = DEFAULT_SEED) -> DataFrame:
    """Pick novel labels at random: ``m`` of them, or ``(pct * n) div 100``.

    Returns every label with ``role`` ('novel'/'seen') and ``novel_rank`` (the
    sample order, 1-based, NULL for seen labels).
    """
    base = labels.select("label").distinct().withColumn("__h", seeded_key("label", salt="novel", seed=seed))
    r = small_rank(base, [F.col("__h"), F.col("label")], "__r")
    if m is None:
        cnt = labels.select("label").distinct().select(F.count(F.lit(1))).scalar()
        limit = F.floor((cnt * F.lit(pct)).cast("double") / F.lit(100.0)).cast("long")
    else:
        limit = F.lit(m)
    novel = F.col("__r") <= limit
    return r.select("label",
                    F.when(novel, F.lit("novel")).otherwise(F.lit("seen")).alias("role"),
                    F.when(novel, F.col("__r")).alias("novel_rank"))


def seen_labels(all_labels: DataFrame, novel: DataFrame) -> DataFrame:
    """seen = all labels minus novel ones."""
    return label_except(all_labels, novel)


def drop_labels(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Delete the rows of the given labels (left anti join)."""
    return df.join(labels.select(F.col("label").alias(label)), label, "left_anti")


def normalize_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """X1: '+' and '_' in labels become blanks."""
    return df.withColumn(label, norm_label(label))


def label_text(df: DataFrame, mapping: DataFrame | None = None, label: str = "label",
               out: str = "label_text") -> DataFrame:
    """the text an encoder sees for a label: the mapped text when the
    optional ``(label, label_text)`` table has one, else the label with '_'
    as blanks.  The mapping is label-sized (left join, size-checked broadcast)."""
    fallback = F.translate(F.col(label), "_", " ")
    if mapping is None:
        return df.withColumn(out, fallback)
    m = checked_broadcast(mapping.select(F.col("label").alias(label), F.col("label_text").alias("__lt")))
    return df.join(m, label, "left").withColumn(out, F.coalesce(F.col("__lt"), fallback)).drop("__lt")
