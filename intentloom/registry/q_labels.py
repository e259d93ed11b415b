"""Proofs for label work: distinct labels, dedup, sizes, ids, novel draw, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.operators import labels as L
from intentloom.plans import split_build
from intentloom.registry import query
from intentloom.registry.sqlparts import DEDUP, PART_UTT, ROLES, SPLIT, UTT, VEC, UTT_LANG
from intentloom.sources import views


@query("a1_distinct_labels", sql=f"""
select label, CAST(count(*) over () AS BIGINT) as n_classes from (select distinct label from ({UTT}) where label is not null)
""")
def a1_distinct_labels(spark, d):
    labs = L.distinct_labels(views.utt(spark, d))
    n = labs.select(F.countDistinct("label")).scalar()  # A16
    return labs.select("label", n.alias("n_classes"))


@query("a2_dedup_last_wins", sql=f"select uid, label, ord from ({DEDUP(UTT)})")
def a2_dedup_last_wins(spark, d):
    return L.dedup_last_wins(views.utt(spark, d)).select("uid", "label", "ord")


@query("a3_group_counts", sql=f"""
select label, count(*) as n, count(distinct utterance) as n_texts from ({DEDUP(UTT)}) group by label
""")
def a3_group_counts(spark, d):
    dd = L.dedup_last_wins(views.utt(spark, d))
    return dd.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("utterance").alias("n_texts"))


@query("a4_min_class_size", sql=f"""
with dd as ({DEDUP(PART_UTT)})
select uid, label from dd where label in (select label from dd group by label having count(*) >= 10)
""")
def a4_min_class_size(spark, d):
    return L.min_class_size(L.dedup_last_wins(views.part_utt(spark, d)), 10).select("uid", "label")


@query("a17_label_union", sql=f"""
select distinct label from (select label from ({SPLIT(UTT)}) where part = 'train_seen'
  union all select label from ({SPLIT(UTT)}) where part = 'support_novel' and k = 5)
""")
def a17_label_union(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), materialized=True, columns=("uid", "label", "role", "part", "k"))
    return L.label_union(sp.where(F.col("part") == "train_seen"),
                         sp.where((F.col("part") == "support_novel") & (F.col("k") == 5)))


@query("u6_label_except", sql=f"""
select label from (select distinct label from ({UTT}))
except select label from ({SPLIT(UTT)}) where part = 'train_seen'
""")
def u6_label_except(spark, d):
    u = views.utt(spark, d)
    sp, _ = split_build.build(u)
    return L.label_except(L.distinct_labels(u), sp.where(F.col("part") == "train_seen").select("label"))


@query("w3_label_ids", sql=f"""
select label, CAST(row_number() over (order by label) - 1 AS INTEGER) as label_id from (select distinct label from ({UTT}))
""")
def w3_label_ids(spark, d):
    return L.label_ids(L.distinct_labels(views.utt(spark, d)))


@query("w7_novel_labels", sql=ROLES(UTT, 33))
def w7_novel_labels(spark, d):
    return split_build.roles_of(views.utt(spark, d), pct=33)


@query("j4_seen_labels", sql=f"select label from ({ROLES(UTT, 33)}) where role = 'seen'")
def j4_seen_labels(spark, d):
    r = split_build.roles_of(views.utt(spark, d), pct=33)
    return L.seen_labels(r.select("label"), r.where(F.col("role") == "novel"))


@query("j5_anti_novel", sql=f"""
select uid, label from ({UTT}) where label not in (select label from ({ROLES(UTT, 33)}) where role = 'novel')
""")
def j5_anti_novel(spark, d):
    u = views.utt(spark, d)
    r = split_build.roles_of(u, pct=33)
    return L.drop_labels(u, r.where(F.col("role") == "novel")).select("uid", "label")


@query("f4_known_labels", sql=f"""
select uid, label from ({UTT}) where label in (select label from ({ROLES(UTT, 33)}) where role = 'seen')
""")
def f4_known_labels(spark, d):
    u = views.utt(spark, d)
    r = split_build.roles_of(u, pct=33)
    return L.known_labels(u, r.where(F.col("role") == "seen")).select("uid", "label")


@query("j2_label_lookup", sql=f"""
with ids as (select label, CAST(row_number() over (order by label) - 1 AS INTEGER) as label_id
             from (select distinct label from ({SPLIT(UTT)}) where part = 'support_novel' and k = 5)),
t as (select uid, label from ({SPLIT(UTT)}) where part in ('test_seen', 'test_novel'))
select t.uid, t.label, ids.label_id, CAST(count(*) filter (where ids.label_id is null) over () AS BIGINT) as n_unknown
from t left join ids using (label)
""")
def j2_label_lookup(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), materialized=True, columns=("uid", "label", "role", "part", "k"))
    ids = L.label_ids(sp.where((F.col("part") == "support_novel") & (F.col("k") == 5)).select("label"))
    t = sp.where(F.col("part").isin("test_seen", "test_novel")).select("uid", "label")
    j = L.lookup_ids(t, ids)
    unknown = j.where(F.col("label_id").isNull()).select(F.count(F.lit(1))).scalar()
    return j.select("uid", "label", "label_id", unknown.alias("n_unknown"))


@query("j12_reverse_lookup", sql=f"""
with ids as (select label, CAST(row_number() over (order by label) - 1 AS INTEGER) as label_id from (select distinct label from ({VEC})))
select v.uid, ids.label_id, ids.label as label_name from ({VEC}) v join ids using (label)
""")
def j12_reverse_lookup(spark, d):
    v = views.vec(spark, d)
    ids = L.label_ids(L.distinct_labels(v))
    with_id = L.lookup_ids(v.select("uid", "label"), ids).select("uid", "label_id")
    return L.reverse_lookup(with_id, ids, out="label_name")


@query("x1_norm_label", sql="""
select p_partkey as uid, translate(p_brand || '+' || p_type || '_' || p_name, '+_', '  ') as label_text from part
""")
def x1_norm_label(spark, d):
    p = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("uid"),
        F.concat_ws("", "p_brand", F.lit("+"), "p_type", F.lit("_"), "p_name").alias("label_text"))
    return L.normalize_labels(p, "label_text")


@query("f2_label_filter", sql=f"""
select uid, label, 'keep' as op from ({UTT_LANG}) where label = 'en'
union all select uid, label, 'drop' as op from ({UTT_LANG}) where label <> 'en'
""")
def f2_label_filter(spark, d):
    u = views.utt_lang(spark, d).select("uid", "label")
    return (u.where(F.col("label") == "en").withColumn("op", F.lit("keep"))
            .unionByName(u.where(F.col("label") != "en").withColumn("op", F.lit("drop"))))


@query("f11_label_text", sql=f"""
with r as ({ROLES(UTT, 33)})
select label, coalesce(case when role = 'novel' then 'new intent ' || label end, translate(label, '_', ' ')) as label_text
from r
""")
def f11_label_text(spark, d):
    roles = split_build.roles_of(views.utt(spark, d))
    mapping = roles.where(F.col("role") == "novel").select(
        "label", F.concat(F.lit("new intent "), F.col("label")).alias("label_text"))
    return L.label_text(roles.select("label"), mapping)
