"""Proofs for vector expressions: cosine, safe division, (masked) softmax,
log-softmax, one-hot, fuse, score maps; and null dropping."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.operators import labels as L
from intentloom.operators.joins import counted
from intentloom.plans import proto_eval
from intentloom.registry import query
from intentloom.registry.sqlparts import DIST_SCORES, PROTOS, SUPPORT, VEC
from intentloom.sources import views

WITH_PROTO = f"""
with v as ({VEC}), p as ({PROTOS(SUPPORT(VEC, 5))}),
vp as (select v.uid, v.label, CAST(v.vec AS DOUBLE[]) as x, p.proto from v join p using (label))
"""


def with_proto(spark, d):
    v = views.vec(spark, d)
    p = proto_eval.prototypes_of(proto_eval.support_of(v, 5))
    return v.join(p.select("label", "proto"), "label")


@query("x5_cosine", sql=WITH_PROTO + """
select uid, round(list_dot_product(x, proto) / nullif(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(proto, proto)), 0), 6) as cos
from vp
""")
def x5_cosine(spark, d):
    return with_proto(spark, d).select("uid", F.round(V.cosine("vec", "proto"), 6).alias("cos"))


@query("x6_l2_dist", sql=WITH_PROTO + "select uid, round(list_distance(x, proto), 6) as dist from vp")
def x6_l2_dist(spark, d):
    return with_proto(spark, d).select("uid", F.round(V.l2_dist("vec", "proto"), 6).alias("dist"))


@query("x8_safe_div", sql=f"""
with e as (select uid, unnest(range(len(vec))) as i, CAST(unnest(vec) AS DOUBLE) as x from ({VEC})),
p as (select a.uid, a.i, a.x as n, abs(b.x) - 0.05 as d from e a join e b on a.uid = b.uid and b.i = (a.i + 1) % 64)
select uid, CAST(i AS INTEGER) as i, round(n / (case when d > 1e-8 then d else 1e-8 end) * (case when d > 1e-8 then 1 else 1e-8 end), 6) as q, d > 1e-8 as divided from p
""")
def x8_safe_div(spark, d):
    v = views.vec(spark, d)
    e = v.select("uid", "vec", F.posexplode("vec").alias("i", "n"))
    d = F.abs(F.get("vec", (F.col("i") + 1) % F.size("vec")).cast("double")) - 0.05
    return e.select("uid", F.col("i").cast("int").alias("i"), F.round(  # a floored divisor gives huge values: scaled back
        V.safe_div(F.col("n").cast("double"), d) * F.when(d > 1e-8, F.lit(1.0)).otherwise(F.lit(1e-8)), 6).alias("q"), (d > 1e-8).alias("divided"))


@query("x9_masked_softmax", sql=f"""
with s as (select uid, unnest(range(len(vec))) as i, CAST(unnest(vec) AS DOUBLE) as x from ({VEC})),
m as (select uid, i, CAST(x > 0 AS INTEGER) as mk, x * CAST(x > 0 AS INTEGER) as xm from s),
e as (select uid, i, exp(xm - max(xm) over (partition by uid)) * mk as ex from m)
select uid, CAST(i AS INTEGER) as i, round(ex / coalesce(nullif(sum(ex) over (partition by uid), 0), 1), 6) as p from e
""")
def x9_masked_softmax(spark, d):
    v = views.vec(spark, d).select("uid", F.col("vec").alias("a"))
    p = v.select("uid", V.masked_softmax("a", F.transform("a", lambda x: (x > 0).cast("int"))).alias("p"))
    return p.select("uid", F.posexplode("p").alias("i", "p")).select(
        "uid", F.col("i").cast("int").alias("i"), F.round("p", 6).alias("p"))


@query("x10_log_softmax", sql=f"""
with s as (select uid, unnest(range(len(vec))) as i, CAST(unnest(vec) AS DOUBLE) as x from ({VEC})),
m as (select uid, i, case when abs(x) > 0.05 then x else ln(1e-45) end as b from s),
z as (select *, max(b) over (partition by uid) as top from m)
select uid, CAST(i AS INTEGER) as i, round(b - top - ln(sum(exp(b - top)) over (partition by uid)), 6) as logp from z
""")
def x10_log_softmax(spark, d):
    v = views.vec(spark, d)
    a = F.transform(V.as_double("vec"), lambda x: F.when(F.abs(x) > 0.05, x).otherwise(F.lit(0.0)))
    p = v.select("uid", V.nonzero_log_softmax(a).alias("lp"))
    return p.select("uid", F.posexplode("lp").alias("i", "logp")).select(
        "uid", F.col("i").cast("int").alias("i"), F.round("logp", 6).alias("logp"))


@query("x11_one_hot", sql=f"""
with ids as (select label, CAST(row_number() over (order by label) - 1 AS INTEGER) as label_id from (select distinct label from ({VEC})))
select v.uid, array_to_string(list_transform(range((select count(*) from ids)), lambda i: CAST(i = ids.label_id AS INTEGER)), ',') as one_hot
from ({VEC}) v join ids using (label)
""")
def x11_one_hot(spark, d):
    v = views.vec(spark, d)
    ids = L.label_ids(L.distinct_labels(v))
    ids, width = counted(ids)
    j = v.join(ids, "label")
    return j.select("uid", F.array_join(F.transform(V.one_hot("label_id", width), lambda x: x.cast("string")), ",").alias("one_hot"))


@query("x14_fuse", sql=WITH_PROTO + """
, f as (select uid, list_concat(x, proto, list_transform(list_zip(x, proto), lambda z: abs(z[1] - z[2])),
                                list_transform(list_zip(x, proto), lambda z: z[1] * z[2])) as f from vp)
select uid, CAST(len(f) AS INTEGER) as width, round(list_sum(f), 6) as fused_sum,
       round(sqrt(list_dot_product(f, f)), 6) as fused_norm from f
""")
def x14_fuse(spark, d):
    f = with_proto(spark, d).select("uid", V.fuse("vec", "proto").alias("f"))
    return f.select("uid", F.size("f").alias("width"), F.round(V.vsum("f"), 6).alias("fused_sum"),
                    F.round(V.norm("f"), 6).alias("fused_norm"))


@query("x23_score_map", sql=f"""
with s as ({DIST_SCORES()}),
m as (select uid, any_value(truth) as truth, map_from_entries(list(struct_pack(k := label, v := score))) as m from s group by uid)
select uid, CAST(cardinality(m) AS INTEGER) as n_labels, round(m[truth], 6) as truth_score from m
""")
def x23_score_map(spark, d):
    s = proto_eval.distance_scores(views.vec(spark, d), 5)
    m = s.groupBy("uid").agg(F.first("truth").alias("truth"),
                             F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("m"))
    return m.select("uid", F.size("m").alias("n_labels"), F.round(F.element_at("m", F.col("truth")), 6).alias("truth_score"))


@query("f1_dropna", sql="""
select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id)
where d.doc_id is not null and d.text is not null and d.source is not null and l.quality is not null and l.toxic is not null
""")
def f1_dropna(spark, d):
    return views.lab(spark, d).na.drop().select("doc_id", "quality", "toxic")
