"""Proofs for entailment pairs, negative sampling and training modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.operators import pairs as P
from intentloom.plans import split_build
from intentloom.registry import query
from intentloom.registry.sqlparts import H, SPLIT, UTT
from intentloom.sources import views

SUBSETS = f"""
with sp as ({SPLIT(UTT)}),
s as (select uid, 'train' as origin, label from sp where part = 'train_seen'
      union all select uid, 'support' as origin, label from sp where part = 'support_novel' and k = 5),
c as (select distinct origin, label as label_name from s),
pairs as (select s.uid, s.origin, c.label_name, CAST(s.label = c.label_name AS INTEGER) as label from s join c using (origin))
"""

SAMPLED = """,
tp as (select * from pairs where origin = 'train'),
pos as (select * from tp where label = 1),
neg as (select *, row_number() over (order by {h}, uid, label_name) as rn from tp where label = 0),
sampled as (select uid, origin, label_name, label from pos union all
            select uid, origin, label_name, label from neg
            where rn <= least(2 * (select count(*) from pos), (select count(*) from neg)))
""".format(h=H("neg", "uid", "label_name"))


def subsets(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), materialized=True, columns=("uid", "label", "role", "part", "k"))
    train = sp.where(F.col("part") == "train_seen").select("uid", "label").withColumn("origin", F.lit("train"))
    sup = (sp.where((F.col("part") == "support_novel") & (F.col("k") == 5)).select("uid", "label")
           .withColumn("origin", F.lit("support")))
    return train, sup


@query("j1_entail_pairs", sql=SUBSETS + "select * from pairs")
def j1_entail_pairs(spark, d):
    train, sup = subsets(spark, d)
    return P.entailment_pairs(train.unionByName(sup), scope="origin")


@query("a13_neg_sample", sql=SUBSETS + SAMPLED + "select uid, label_name, label from sampled")
def a13_neg_sample(spark, d):
    train, _ = subsets(spark, d)
    return P.sample_negatives(P.entailment_pairs(train, scope="origin"), ratio=2, positives=P.entailment_positives(train)).select("uid", "label_name", "label")


@query("f9_train_mode", sql=SUBSETS + SAMPLED + """
select *, 'yes' as mode from (select * from sampled union all select * from pairs where origin = 'support')
union all select *, 'no' as mode from pairs where origin = 'support'
union all select *, 'none' as mode from sampled
""")
def f9_train_mode(spark, d):
    train, sup = subsets(spark, d)
    tp = P.sample_negatives(P.entailment_pairs(train, scope="origin"), ratio=2, positives=P.entailment_positives(train))
    sp = P.entailment_pairs(sup, scope="origin")
    out = None
    for mode, shots, flag in (("yes", 5, "yes"), ("no", 5, "no"), ("none", 0, "yes")):
        m = P.train_mode(tp, sp, shots, flag).withColumn("mode", F.lit(mode))
        out = m if out is None else out.unionByName(m)
    return out
