"""Proofs for splitting and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.operators import split as S
from intentloom.operators import labels as L
from intentloom.plans import split_build
from intentloom.registry import query
from intentloom.registry.sqlparts import DEDUP, H, RANKED, ROLES, SPLIT, SUPPORT, UTT, UTT_LANG
from intentloom.session import materialize

SPLIT_UTT = SPLIT(UTT)


@query("w1_shuffle_rank", sql=f"select uid, label, rn, CAST(n AS BIGINT) as n from ({RANKED(UTT)})")
def w1_shuffle_rank(spark, d):
    return S.shuffle_rank(views_utt(spark, d)).select("uid", "label", "rn", "n")


def views_utt(spark, d):
    from intentloom.sources import views
    return views.utt(spark, d)


@query("w2_ratio_split", sql=f"""
select uid, label, case when rn <= floor(CAST(n * 2 AS DOUBLE) / 3.0) then 'train' else 'test' end as part
from ({RANKED(DEDUP(UTT))})
""")
def w2_ratio_split(spark, d):
    return S.ratio_split(L.dedup_last_wins(views_utt(spark, d))).select("uid", "label", "part")


@query("w5_kshot_support", sql=f"select uid, label from ({SUPPORT(UTT, 5)})")
def w5_kshot_support(spark, d):
    return S.kshot_support(views_utt(spark, d), 5).select("uid", "label")


@query("s10_split_parts", sql=f"select uid, label, role, part, k from ({SPLIT_UTT})")
def s10_split_parts(spark, d):
    sp, _ = split_build.build(views_utt(spark, d))
    return sp.select("uid", "label", "role", "part", "k")


@query("u1_test_joint", sql=f"select uid, label, part from ({SPLIT_UTT}) where part in ('test_seen', 'test_novel')")
def u1_test_joint(spark, d):
    sp, _ = split_build.build(views_utt(spark, d))
    return S.test_joint(sp).select("uid", "label", "part")


@query("u2_support_joint", sql=f"""
select uid, label, part from ({SPLIT_UTT}) where part in ('support_novel', 'support_seen') and k = 5
""")
def u2_support_joint(spark, d):
    sp, _ = split_build.build(views_utt(spark, d))
    return S.support_joint(sp, 5).select("uid", "label", "part")


@query("s13_eval_scope", sql=f"""
with sp as ({SPLIT_UTT}), sc as (select unnest(['joint', 'novel', 'seen']) as scope)
select scope, uid, label, part, k from sp, sc
where (k = 0 and part in ('test_seen', 'test_novel') or k = 1) and (scope = 'joint' or part like '%' || scope)
""")
def s13_eval_scope(spark, d):
    sp, _ = split_build.build(views_utt(spark, d), materialized=True, columns=("uid", "label", "role", "part", "k"))
    rows = [r.withColumn("scope", F.lit(scope)) for scope in ("joint", "novel", "seen") for r in S.eval_scope(sp, scope, k=1)]
    return reduce(DataFrame.unionByName, rows).select("scope", "uid", "label", "part", "k")


@query("f3_reassign_class", sql=f"""
with sp as ({SPLIT_UTT}),
mv as (select min(label) as label from sp where role = 'seen')
select uid, label, case when label in (select label from mv) then 'novel' else role end as role,
       case when label in (select label from mv) then
         (case part when 'test_seen' then 'test_novel' when 'support_seen' then 'support_novel' else part end)
       else part end as part, k
from sp where not (label in (select label from mv) and part = 'train_seen')
""")
def f3_reassign_class(spark, d):
    sp, _ = split_build.build(views_utt(spark, d), materialized=True, columns=("uid", "label", "role", "part", "k"))
    moved = sp.where(F.col("role") == "seen").agg(F.min("label").alias("label"))
    return S.reassign_class(sp, moved).select("uid", "label", "role", "part", "k")


@query("e7_split_audit", sql=f"""
with sp as ({SPLIT_UTT}), roles as ({ROLES(UTT, 33)}),
cnt as (select label, part, k, count(*) as n from sp group by label, part, k),
sup as (select r.label, 'support_' || r.role as part, k from roles r, (select unnest([1, 5]) as k)),
full_ as (select s.label, s.part, s.k, coalesce(c.n, 0) as n from sup s left join cnt c
          on c.label = s.label and c.part = s.part and c.k = s.k),
allr as (select * from full_ union all select * from cnt where k = 0)
select label, part, CAST(k AS INTEGER) as k, CAST(n AS BIGINT) as n,
       CAST(case when k > 0 then greatest(k - n, 0) else 0 end AS BIGINT) as short, false as empty_label from allr
union all select label, 'none', 0, 0, 0, true from roles where label not in (select label from sp)
""")
def e7_split_audit(spark, d):
    u = views_utt(spark, d)
    sp, roles = split_build.build(u, materialized=True, columns=("uid", "label", "role", "part", "k"))
    return S.split_audit(sp, roles, shots=(1, 5))


@query("e7_cross_part_texts", sql=f"""
with sp as ({SPLIT(UTT_LANG, dedup=UTT_LANG)})
select distinct md5(a.utterance) as text_md5 from sp a join sp b on a.utterance = b.utterance
where a.part = 'test_seen' and b.part = 'train_seen'
""")
def e7_cross_part_texts(spark, d):
    from intentloom.sources import views
    # copies are left in: deduplicated rows could not share a text
    u = views.utt_lang(spark, d)
    sp = materialize(S.split_sets(u, split_build.roles_of(u, 33, None)))
    return S.cross_part_texts(sp, "test_seen", "train_seen").select(F.md5("utterance").alias("text_md5"))


@query("w9_validation_slice", sql=f"""
with dd as ({DEDUP(UTT)})
select uid, CAST(row_number() over (order by ord) AS BIGINT) as pos,
       case when row_number() over (order by ord) <= floor(CAST((select count(*) from dd) AS DOUBLE) / 9.0)
            then 'valid' else 'train' end as part from dd
""")
def w9_validation_slice(spark, d):
    return S.validation_slice(L.dedup_last_wins(views_utt(spark, d))).select("uid", "pos", "part")


@query("w17_global_shuffle", sql=f"""
select uid, CAST(row_number() over (order by {H('shuffle', 'uid')}, uid) AS BIGINT) as rn from ({UTT})
""")
def w17_global_shuffle(spark, d):
    return S.shuffle_rank(views_utt(spark, d), by=None, salt="shuffle", total=None).select("uid", "rn")


@query("f5_row_range", sql=f"""
with base as (select uid, ord from ({UTT_LANG}) where label = 'en'),
ins as (select uid, ord from ({UTT_LANG}) where label = 'de'),
b as (select uid, row_number() over (order by ord) - 1 as p from base),
i as (select uid, row_number() over (order by ord) - 1 as p from ins)
select uid, CAST(case when p < 381 then p else p + (select count(*) from ins) end AS BIGINT) as pos from b
union all select uid, CAST(p + 381 AS BIGINT) as pos from i
""")
def f5_row_range(spark, d):
    from intentloom.sources import views
    u = views.utt_lang(spark, d).select("uid", "label", "ord")
    return S.splice(u.where(F.col("label") == "en"), u.where(F.col("label") == "de"), 381).select("uid", "pos")


@query("f5_position_slice", sql=f"""
select uid, pos from (select uid, CAST(row_number() over (order by ord) - 1 AS BIGINT) as pos from ({UTT}))
where pos >= 381
""")
def f5_position_slice(spark, d):
    return S.position_slice(views_utt(spark, d), 381).select("uid", "pos")


@query("w9_validation_held_out", sql=f"""
with dd as ({DEDUP(UTT)})
select uid, CAST(row_number() over (order by {H('valid', 'uid')}, uid) AS BIGINT) as pos,
       case when row_number() over (order by {H('valid', 'uid')}, uid) <= floor(CAST((select count(*) from dd) AS DOUBLE) / 9.0)
            then 'valid' else 'train' end as part from dd
""")
def w9_validation_held_out(spark, d):
    return S.validation_slice(L.dedup_last_wins(views_utt(spark, d)), held_out=True).select("uid", "pos", "part")
