"""Episodic evaluation end to end (all episodes in one job):

classes per episode -> K support + Q query rows per class -> per (episode,
class) prototypes -> nearest prototype among the episode's classes -> accuracy
per episode -> mean and population std.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.operators import episodes as EP
from intentloom.operators import score as SC
from intentloom.operators.joins import checked_broadcast
from intentloom.session import materialize

TIE_DIGITS = 9


def samples(rows: DataFrame, episodes: int = 20, n_way: int = 5, k: int = 5, q: int = 5,
            extra: int = 0, queries: DataFrame | None = None, exclude_support: bool = True) -> DataFrame:
    """``extra`` = ``n_way`` is the joint target (2N classes); classes are those of the query table, if there is one."""
    classes = EP.episode_classes((rows if queries is None else queries).select("label"), episodes, n_way, extra)
    return materialize(EP.episode_samples(rows, classes, k, q, queries=queries, exclude_support=exclude_support), "episodes")


def query_key():
    return F.col("class_id").cast("long") * (1 << 32) + F.col("slot")


def queries_of(smp: DataFrame) -> DataFrame:
    """Query rows keyed by (episode, qkey = class_id * 2**32 + slot; both are 32 bits)."""
    return smp.where(F.col("role") == "query").select(
        "episode", F.col("class_id").alias("q_class"),
        query_key().alias("qkey"), "uid", "vec")


def episode_predictions(smp: DataFrame, weights=None) -> DataFrame:
    """``(episode, qkey, q_class, pred, logit)``: logit = minus the (optionally
    per-dimension weighted, X7) squared distance to each class prototype of
    the episode; ties go to the lowest class id."""
    protos = SC.prototypes(smp.where(F.col("role") == "support"), by=("episode", "class_id"))
    q = queries_of(smp)
    p = checked_broadcast(protos.select("episode", F.col("class_id").alias("__c"), F.col("proto").alias("__p")))
    w = None if weights is None else F.array(*[F.lit(float(x)) for x in weights])
    j = q.join(p, "episode").withColumn("__l", F.round(-V.sq_dist("vec", "__p", w), TIE_DIGITS))
    return j.groupBy("episode", "qkey", "q_class").agg(
        F.min_by("__c", F.struct(-F.col("__l"), F.col("__c"))).alias("pred"), F.max("__l").alias("logit"))


def episode_accuracy(smp: DataFrame) -> DataFrame:
    pr = episode_predictions(smp)
    return pr.groupBy("episode").agg(F.avg((F.col("pred") == F.col("q_class")).cast("double")).alias("acc"))
