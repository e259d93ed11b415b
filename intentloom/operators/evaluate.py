"""Evaluation: classification report, confusion matrix, accuracy summaries,
batch means, running best, log loss.

Everything is one or two aggregations over ``(truth, pred)`` counts; the
per-class tables are label-sized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intentloom.operators.joins import candidate_blocks, checked_broadcast, each_candidate
from intentloom.operators.rank import null_safe_join

DIGITS = 6


def _r(c):
    return F.round(c, DIGITS)


def pair_counts(pred: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """``(label, pred, n)`` counts; the one pass every report is built from."""
    return pred.groupBy(F.col(truth).alias("label"), F.col(guess).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(pred: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """Per class precision, recall, F1 and support, then 'accuracy',
    'macro avg' and 'weighted avg' rows.

    Classes are those in the truth or the prediction; an undefined ratio counts
    as 0.0 (as the reference's report does).  The 'accuracy' row carries the
    accuracy in ``f1`` and the total in ``support``.  Rows whose truth or
    prediction is NULL (e.g. a query with no candidate label) count against
    recall but are not a class.

    One aggregation of (truth, pred) counts; each count row feeds its truth
    class (support, tp) and its predicted class (predicted count); one rollup
    over the label-sized class table gives the class rows and the total row,
    which is exploded into the three summary rows.
    """
    pc = pair_counts(pred, truth, guess)
    contrib = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("np"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("np"),
                 F.lit(0).cast("long").alias("tp")))
    cls = (pc.select(F.explode(contrib).alias("e")).where(F.col("e.cls").isNotNull())
           .groupBy(F.col("e.cls").alias("label"))
           .agg(F.sum("e.sup").alias("support"), F.sum("e.np").alias("npred"), F.sum("e.tp").alias("tp")))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    cls = cls.withColumn("p", ratio("tp", "npred")).withColumn("r", ratio("tp", "support"))
    cls = cls.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    g = cls.rollup("label").agg(
        F.grouping("label").alias("g"), F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f").alias("f"),
        F.sum("support").alias("total"), F.sum("tp").alias("tps"),
        F.sum(F.col("p") * F.col("support")).alias("wp"), F.sum(F.col("r") * F.col("support")).alias("wr"),
        F.sum(F.col("f") * F.col("support")).alias("wf"))
    wdiv = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total").cast("double")), F.lit(0.0))
    nul = F.lit(None).cast("double")
    row = lambda name, p, r, f: F.struct(name.alias("label"), p.alias("precision"), r.alias("recall"),
                                         f.alias("f1"), F.col("total").alias("support"))
    out = F.when(F.col("g") == 0, F.array(row(F.col("label"), F.col("p"), F.col("r"), F.col("f")))).otherwise(F.array(
        row(F.lit("accuracy"), nul, nul, F.coalesce(F.try_divide(F.col("tps").cast("double"),
                                                                 F.col("total").cast("double")), F.lit(0.0))),
        row(F.lit("macro avg"), F.col("p"), F.col("r"), F.col("f")),
        row(F.lit("weighted avg"), wdiv("wp"), wdiv("wr"), wdiv("wf"))))
    rows = g.select(F.explode(out).alias("o")).select("o.*")
    return rows.select("label", _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"),
                       _r(F.col("f1")).alias("f1"), F.col("support").cast("long").alias("support"))


def confusion(pred: DataFrame, labels: DataFrame | None = None, truth: str = "label",
              guess: str = "pred", block_bytes: int | None = None) -> DataFrame:
    """Zero-filled confusion matrix in long form ``(label, pred, n)``, truth
    in rows; classes = ``labels`` or truth union prediction.  Zeros are the
    feature, so it has label x label rows."""
    pc = pair_counts(pred, truth, guess).where(F.col("label").isNotNull() & F.col("pred").isNotNull())
    if labels is None:
        labels = pc.select("label").unionByName(pc.select(F.col("pred").alias("label"))).distinct()
    lab = labels.select("label").distinct()
    # every truth label row explodes the label list (in bounded blocks), so the
    # L*L cells are generated across tasks, without a join
    grid = each_candidate(lab, candidate_blocks(lab, ["label"], block_bytes), lambda a: a,
                          lambda x: x.select("label", F.col("__c.label").alias("pred")))
    return grid.join(pc, ["label", "pred"], "left").select(
        "label", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def unknown_counts(pred: DataFrame, candidates: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """E1's ``(n, n_unknown, n_without)``: rows, rows whose truth is not a candidate label, rows without a
    prediction.  Such rows are wrong in the report, never an error and never left out."""
    known = checked_broadcast(candidates.select(F.col("label").alias(truth), F.lit(True).alias("__known")).distinct())
    return pred.join(known, truth, "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__known").isNull()).alias("n_unknown"),
                                               F.count_if(F.col(guess).isNull()).alias("n_without"))


def accuracy(pred: DataFrame, by=(), truth: str = "label", guess: str = "pred") -> DataFrame:
    """Mean of (pred == truth) per group (or overall); NULL pred = wrong."""
    hit = F.coalesce((F.col(truth) == F.col(guess)).cast("double"), F.lit(0.0))
    return pred.groupBy(*by).agg(F.avg(hit).alias("acc"), F.count(F.lit(1)).alias("n"))


def mean_std(df: DataFrame, value: str, by=(), prefix: str = "") -> DataFrame:
    """Mean and population std over episodes / runs / folds."""
    return df.groupBy(*by).agg(_r(F.avg(value)).alias(f"{prefix}mean"),
                               _r(F.stddev_pop(value)).alias(f"{prefix}std"),
                               F.count(F.lit(1)).alias(f"{prefix}count"))


def moments(df: DataFrame, value: str, by=()) -> DataFrame:
    """A mergeable state per group: count, mean and sum of squared deviations (``n, mean, m2``) of a value."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_moments(states: DataFrame, by=()) -> DataFrame:
    """The states of parts (of runs, of days) as one per group, exact up to rounding: parts need not be kept."""
    total = states.groupBy(*by).agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"))
    if by:  # a row per group
        x = null_safe_join(states.select(*by, F.col("n").alias("__n"), F.col("mean").alias("__m"), "m2"), total, list(by))
    else:
        x = states.select(F.col("n").alias("__n"), F.col("mean").alias("__m"), "m2").withColumn("n", total.select("n").scalar()).withColumn("mean", total.select("mean").scalar())
    return x.groupBy(*by, "n", "mean").agg(F.sum(F.col("m2") + F.col("__n") * F.pow(F.col("__m") - F.col("mean"), 2)).alias("m2"))


def finish_moments(states: DataFrame, by=()) -> DataFrame:
    """``mean, std`` (population) ``, count`` of states."""
    return states.select(*by, _r(F.col("mean")).alias("mean"), _r(F.sqrt(F.try_divide(F.col("m2"), F.col("n")))).alias("std"), F.col("n").alias("count"))


def episode_accuracy(preds: DataFrame, episode: str = "episode", truth: str = "q_class", guess: str = "pred", by=()) -> DataFrame:
    """E3 from any predictions: the accuracy of every episode, ``(by, episode, acc, n)``; no prediction counts as wrong."""
    return accuracy(preds, [*by, episode], truth, guess)


def batch_mean(df: DataFrame, value: str, batch: str = "batch", by=()) -> DataFrame:
    """Mean of per-batch means (not the global mean), per ``by``."""
    per = df.groupBy(*by, batch).agg(F.avg(value).alias("__bm"))
    return per.groupBy(*by).agg(_r(F.avg("__bm")).alias("mean_of_batches"),
                                F.count(F.lit(1)).alias("batches"))


def running_best(trace: DataFrame, step: str = "episode", value: str = "acc", every: int = 100,
                 by=(), bucket: int = 4096) -> DataFrame:
    """Running mean of ``value`` after each step, read every ``every``
    steps, with a flag where it reaches a new best (>= best so far).

    Prefix sums and prefix maxima are computed the skew-safe way: per step
    bucket (``step div bucket``) totals, running sums over the bucket table,
    then a window inside each bucket.  No window ever spans the whole trace.
    """
    by = list(by)
    b = F.floor(F.col(step) / F.lit(bucket)).cast("long")
    x = trace.withColumn("__b", b)
    tot = x.groupBy(*by, "__b").agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__c"))
    wb = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "__b", F.coalesce(F.sum("__s").over(wb), F.lit(0.0)).alias("__so"),
                      F.coalesce(F.sum("__c").over(wb), F.lit(0)).alias("__co"))
    j = x.join(offs, [*by, "__b"])
    wi = Window.partitionBy(*by, "__b").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("running", (F.col("__so") + F.sum(value).over(wi)) / (F.col("__co") + F.count(F.lit(1)).over(wi)))
    r = j.where((F.col(step) % every) == (every - 1)).select(*by, step, "__b", "running")
    bm = r.groupBy(*by, "__b").agg(F.max("running").alias("__m"))
    bo = bm.select(*by, "__b", F.max("__m").over(wb).alias("__mo"))
    r = r.join(bo, [*by, "__b"]).withColumn(
        "best_so_far", F.greatest(F.coalesce(F.col("__mo"), F.col("running")), F.max("running").over(wi)))
    return r.select(*by, step, _r(F.col("running")).alias("running"),
                    (F.col("running") >= F.col("best_so_far")).alias("is_best"))


LEAST_PROB = 2.2250738585072014e-308  # the smallest normal double: an underflow to 0 costs about 708


def log_loss(probs: DataFrame, key: str = "uid", truth: str = "truth", prob: str = "prob",
             by=()) -> DataFrame:
    """Cross-entropy: mean of -ln(probability given to the true class); a
    probability that underflowed to 0 counts with the least positive one."""
    t = probs.where(F.col("label") == F.col(truth))
    return t.groupBy(*by).agg(_r(F.avg(-F.log(F.greatest(F.col(prob), F.lit(LEAST_PROB))))).alias("log_loss"),
                              F.count(F.lit(1)).alias("n"))


def log_loss_known(probs: DataFrame, key: str = "uid", truth: str = "truth", prob: str = "prob") -> DataFrame:
    """X26 with the queries whose truth is not a candidate counted: log_loss, n, n_unknown."""
    q = probs.groupBy(key).agg(F.max(F.when(F.col("label") == F.col(truth), F.col(prob))).alias("__p"))
    known = q.withColumn("__l", F.when(F.col("__p").isNotNull(), -F.log(F.greatest(F.col("__p"), F.lit(LEAST_PROB)))))
    return known.agg(_r(F.avg("__l")).alias("log_loss"), F.count("__p").alias("n"), F.count_if(F.col("__p").isNull()).alias("n_unknown"))
