"""Parameter sweeps over a split: seen-train fraction, label space, shots.

A sweep never re-runs the split.  The split is ranked once; each sweep step is
a filter over the same ranks, fanned out by exploding a small, fixed list of
steps (the step list is a parameter, not data), and written with ``pct`` or
``k`` as the partition column.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.operators.evaluate import accuracy
from intentloom.operators.joins import checked_broadcast
from intentloom.operators.rank import small_rank
from intentloom.operators.score import nearest_prototype

SEEN_FRACTION_STEPS = (20, 40, 60, 80, 100)
LABEL_SPACE_STEPS = tuple(range(10, 110, 10))
SHOT_STEPS = (1, 5, 10, 20)


def seen_fraction_sweep(split_ranked: DataFrame, pcts=SEEN_FRACTION_STEPS) -> DataFrame:
    """For each p, train_seen keeps its first ``(p * train_n) div 100`` rows
    (split order); test and support parts are unchanged.

    ``split_ranked`` is ``split_sets(..., keep_rank=True)``.  Adds ``pct``.
    """
    x = split_ranked.withColumn("pct", F.explode(F.array(*[F.lit(int(p)) for p in pcts])))
    lim = F.floor((F.col("pct") * F.col("train_n")).cast("double") / F.lit(100.0))
    keep = (F.col("part") != "train_seen") | (F.col("rn") <= lim)
    return x.where(keep)


def label_space_steps(roles: DataFrame, pcts=LABEL_SPACE_STEPS) -> DataFrame:
    """The labels of each step: the first ``(pct * n_seen) div 100`` seen labels
    (sorted) and the first ``(pct * n_novel) div 100`` novel labels (draw order).

    Returns ``(pct, label)``; label-sized x steps.
    """
    seen = small_rank(roles.where(F.col("role") == "seen").select("label"), [F.col("label")], "r") \
        .withColumn("role", F.lit("seen"))
    novel = roles.where(F.col("role") == "novel").select("label", F.col("novel_rank").alias("r")) \
        .withColumn("role", F.lit("novel"))
    both = seen.unionByName(novel)
    n = both.groupBy("role").agg(F.count(F.lit(1)).alias("n_role"))
    x = both.join(n, "role").withColumn("pct", F.explode(F.array(*[F.lit(int(p)) for p in pcts])))
    return x.where(F.col("r") <= F.floor((F.col("pct") * F.col("n_role")).cast("double") / F.lit(100.0))) \
        .select("pct", "label")


def label_space_sweep(split: DataFrame, roles: DataFrame, pcts=LABEL_SPACE_STEPS) -> DataFrame:
    """The split restricted to each step's labels (prefixes grow with the
    step).  Each class's rows and ranks are the same in every step."""
    steps = checked_broadcast(label_space_steps(roles, pcts))
    return split.join(steps, "label")


def step_prototypes(rows: DataFrame, steps, rank: str = "rn", vec: str = "vec", step: str = "step") -> DataFrame:
    """Prototypes of nested supports for every step in one pass: ``(step, label, proto, n_support)``.

    ``rows(label, rank, vec)``; step s of a label holds its rows of rank <= ``limit(s)``, where ``steps`` is a list of
    ``(s, limit)`` with limits (numbers or columns of ``rows``) that do not fall.  Each row is added to the sum of the first step that holds it
    only (a partial aggregate, labels x steps rows); a step's sum and count are those of the steps up to it."""
    numbers = [n for n, _ in steps]
    first = F.lit(None).cast("int")
    for i, (_, limit) in reversed(list(enumerate(steps))):
        first = F.when(F.col(rank) <= (F.lit(limit) if isinstance(limit, (int, float)) else limit), F.lit(i)).otherwise(first)
    x = rows.select("label", first.alias("__i"), array_to_vector(V.as_double(vec)).alias("__v")).where(F.col("__i").isNotNull())
    sums = x.groupBy("label", "__i").agg(Summarizer.sum(F.col("__v")).alias("__s"), F.count(F.lit(1)).alias("__n"))
    up = sums.withColumn("__i", F.explode(F.sequence(F.col("__i"), F.lit(len(numbers) - 1)))).groupBy("label", "__i").agg(
        Summarizer.sum(F.col("__s")).alias("__s"), F.sum("__n").alias("n_support"))
    mean = F.transform(vector_to_array("__s"), lambda v: v / F.col("n_support"))
    return up.select(F.get(F.array(*(F.lit(int(n)) for n in numbers)), F.col("__i")).alias(step), "label", mean.alias("proto"), "n_support")


def step_accuracy(queries: DataFrame, protos: DataFrame, steps, step: str = "step", key: str = "uid", vec: str = "vec") -> DataFrame:
    """``(step, acc, n)`` of nearest-prototype predictions: every query against the prototypes of every step, in one scan.
    ``queries`` may hold ``step`` itself, where a step has its own queries."""
    q = queries if step in queries.columns else queries.withColumn(step, F.explode(F.array(*(F.lit(int(s)) for s in steps))))
    best = nearest_prototype(q, protos, scope_col=step, key=key, vec=vec, carry=(step, "label"))
    return accuracy(best, [step])


def shots_sweep(split: DataFrame, ks=SHOT_STEPS) -> DataFrame:
    """Support parts for every K of the list (split built with
    ``shots=ks``); data parts are shared by all K."""
    return split.where(F.col("k").isin(*[int(k) for k in ks]) | (F.col("k") == 0))
