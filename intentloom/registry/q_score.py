"""Proofs for scoring: prototypes, nearest prototype, zero-shot cosine, ranking,
softmax, pair scoring, dispersion, attentive prototypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.operators import score as SC
from intentloom.registry import query
from intentloom.registry.sqlparts import NEAREST, PROTOS, REPORT, SUPPORT, VEC
from intentloom.sources import views
from intentloom.plans import proto_eval


@query("a7_prototypes", sql=f"""
with p as ({PROTOS(SUPPORT(VEC, 5))}),
e as (select label, unnest(range(len(proto))) as dim, unnest(proto) as x from p)
select label, CAST(dim AS BIGINT) as dim, round(x, 6) as value from e
""")
def a7_prototypes(spark, d):
    sup = proto_eval.support_of(views.vec(spark, d), 5)
    p = proto_eval.prototypes_of(sup)
    return p.select("label", F.posexplode("proto").alias("dim", "x")).select(
        "label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("value"))


@query("j6_nearest_proto", sql=NEAREST.format(
    queries=f"select * from ({VEC}) where uid not in (select uid from ({SUPPORT(VEC, 5)}))",
    protos=PROTOS(SUPPORT(VEC, 5))))
def j6_nearest_proto(spark, d):
    return proto_eval.nearest_predictions(views.vec(spark, d), 5)


@query("j6_nearest_proto_blocks", sql=NEAREST.format(
    queries=f"select * from ({VEC}) where uid not in (select uid from ({SUPPORT(VEC, 5)}))",
    protos=PROTOS(SUPPORT(VEC, 5))))
def j6_nearest_proto_blocks(spark, d):
    """The candidates in several blocks, as above the size bound."""
    return proto_eval.nearest_predictions(views.vec(spark, d), 5, block_bytes=2048)


@query("j6_indexed", sql=NEAREST.format(
    queries=f"select * from ({VEC}) where uid not in (select uid from ({SUPPORT(VEC, 5)}))",
    protos=PROTOS(SUPPORT(VEC, 5))))
def j6_indexed(spark, d):
    """Through the metric index: the same rows, measuring only the balls that the triangle inequality leaves open."""
    return proto_eval.nearest_predictions(views.vec(spark, d), 5, index=True)


@query("j6_nearest_row", sql=f"""
with v as ({VEC}), s as ({SUPPORT(VEC, 5)}), q as (select * from v where uid not in (select uid from s))
select q.uid, arg_min(s.uid, struct_pack(d := round(list_distance(CAST(q.vec AS DOUBLE[]), CAST(s.vec AS DOUBLE[])), 9), c := lpad(CAST(s.uid AS VARCHAR), 12, '0'))) as nearest,
       round(min(round(list_distance(CAST(q.vec AS DOUBLE[]), CAST(s.vec AS DOUBLE[])), 9)), 6) as score, true as bounded
from q, s group by q.uid
""")
def j6_nearest_row(spark, d):
    """The nearest support row (not class) of every other row, through the index; no query visits more balls than there are."""
    from intentloom.operators import metric_index as MI
    vecs = views.vec(spark, d)
    sup, queries = proto_eval._support_and_rest(vecs, 5)
    cands = SC.with_scope(sup.select(F.lpad(F.col("uid").cast("string"), 12, "0").alias("label"), V.as_double("vec").alias("__p")), "all").select("scope", "label", "__p")
    near = MI.nearest(queries, cands, lambda c: F.round(V.l2_dist("vec", c["__p"]), SC.TIE_DIGITS), lambda x: x)
    return near.select("uid", F.col("pred").cast("long").alias("nearest"), F.round("order", 6).alias("score"),
                       ((F.col("visited") >= 1) & (F.col("visited") <= F.col("balls"))).alias("bounded"))


@query("e1_class_report", sql=REPORT(NEAREST.format(
    queries=f"select * from ({VEC}) where uid not in (select uid from ({SUPPORT(VEC, 5)}))",
    protos=PROTOS(SUPPORT(VEC, 5)))))
def e1_class_report(spark, d):
    return proto_eval.report(views.vec(spark, d), 5)
