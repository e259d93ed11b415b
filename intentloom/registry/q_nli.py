"""Proofs for the entailment-style plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.plans import nli, split_build
from intentloom.registry import query
from intentloom.registry.sqlparts import BOW_TOKENS, H, HINT, REPORT, SPLIT, UTT
from intentloom.sources import views

COS_PRED = f"""
with sp as ({SPLIT(UTT)}),
t as (select uid, label, utterance from sp where part in ('test_seen', 'test_novel')),
s as (select uid, label, utterance from sp where part in ('support_seen', 'support_novel') and k = 5),
enc as (select uid, CAST({HINT('w')} % 64 AS BIGINT) as dim, CAST(count(*) AS DOUBLE) as v from
          (select uid, unnest({BOW_TOKENS('utterance')}) as w from (select uid, utterance from t union all select uid, utterance from s))
        group by all),
nsup as (select label, count(*) as n from s group by label),
p as (select s.label, e.dim, sum(e.v) / any_value(nsup.n) as v from s join enc e using (uid) join nsup using (label) group by all),
pn as (select label, sqrt(sum(v * v)) as nrm from p group by label),
q as (select t.uid, t.label, e.dim, e.v from t join enc e using (uid)),
qn as (select uid, sqrt(sum(v * v)) as nrm from q group by uid),
dots as (select q.uid, p.label as cand, sum(q.v * p.v) as dot from q join p using (dim) group by all),
labs as (select distinct label as cand from s),
sc as (select t.uid, t.label, l.cand,
              round(coalesce(coalesce(d.dot, 0.0) / nullif(qn.nrm * pn.nrm, 0), -2.0), 9) as s
       from t cross join labs l left join dots d on d.uid = t.uid and d.cand = l.cand
       left join qn on qn.uid = t.uid left join pn on pn.label = l.cand)
select uid, label, arg_min(cand, struct_pack(ns := -s, c := cand)) as pred, round(max(s), 6) as score from sc group by all
"""


@query("nli_cosine_predictions", sql=COS_PRED)
def nli_cosine_predictions(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), materialized=True)
    return nli.cosine_predictions(sp)


@query("nli_cosine_report", sql=REPORT(f"select label, pred from ({COS_PRED})"))
def nli_cosine_report(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), materialized=True)
    return nli.cosine_report(sp)


@query("nli_inference_pairs", sql=f"""
with sp as ({SPLIT(UTT)}),
t as (select uid, label from sp where part = 'test_novel'),
c as (select distinct label as label_name from sp where part = 'support_novel' and k = 1)
select t.uid, 'novel' as origin, c.label_name, CAST(t.label = c.label_name AS INTEGER) as label from t, c
""")
def nli_inference_pairs(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), materialized=True, columns=("uid", "label", "role", "part", "k"))
    return nli.inference_pairs(sp, "novel", 1)


@query("nli_training_table", sql=f"""
with sp as ({SPLIT(UTT)}), tr as (select uid, label from sp where part = 'train_seen'), su as (select uid, label from sp where part = 'support_novel' and k = 5),
tp as (select uid, l.label_name, CAST(tr.label = l.label_name AS INTEGER) as label from tr, (select distinct label as label_name from tr) l),
ng as (select uid, label_name, label, row_number() over (order by {H('neg', 'uid', 'label_name')}, uid, label_name) as rn from tp where label = 0)
select 'train' as origin, uid, label_name, label from tp where label = 1
union all select 'train', uid, label_name, label from ng where rn <= 2 * (select count(*) from tp where label = 1)
union all select 'support', uid, l.label_name, CAST(su.label = l.label_name AS INTEGER) from su, (select distinct label as label_name from su) l
""")
def nli_training_table(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), materialized=True, columns=("uid", "label", "role", "part", "k"))
    return nli.training_table(sp).select("origin", "uid", "label_name", "label")
