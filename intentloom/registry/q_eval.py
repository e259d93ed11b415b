"""Proofs for evaluation: confusion, accuracy summaries, batches, running best,
rankings, softmax and log loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.operators import evaluate as E
from intentloom.operators import score as SC
from intentloom.operators.batches import eval_batches
from intentloom.plans import proto_eval
from intentloom.registry import query
from intentloom.registry.sqlparts import DIST_SCORES, H, HINT, NEAREST_VEC, VEC
from intentloom.sources import views


@query("e2_confusion", sql=f"""
with p as ({NEAREST_VEC()}),
pc as (select label, pred, count(*) as n from p group by label, pred),
l as (select label from pc union select pred from pc)
select a.label, b.label as pred, CAST(coalesce(pc.n, 0) AS BIGINT) as n
from l a cross join l b left join pc on pc.label = a.label and pc.pred = b.label
""")
def e2_confusion(spark, d):
    return E.confusion(proto_eval.nearest_predictions(views.vec(spark, d), 5))


@query("e2_confusion_blocks", sql=f"""
with p as ({NEAREST_VEC()}),
pc as (select label, pred, count(*) as n from p group by label, pred),
l as (select label from pc union select pred from pc)
select a.label, b.label as pred, CAST(coalesce(pc.n, 0) AS BIGINT) as n
from l a cross join l b left join pc on pc.label = a.label and pc.pred = b.label
""")
def e2_confusion_blocks(spark, d):
    return E.confusion(proto_eval.nearest_predictions(views.vec(spark, d), 5), block_bytes=200)


@query("e1_unknown_counts", sql=f"""
select count(*) as n, CAST(count(*) filter (where label = '3') AS BIGINT) as n_unknown, CAST(0 AS BIGINT) as n_without from ({VEC})
""")
def e1_unknown_counts(spark, d):
    """Label 3 has no prototype: its rows are predicted all the same, and counted as unknown."""
    v = SC.with_scope(views.vec(spark, d), "all")
    protos = SC.with_scope(SC.prototypes(v.where(F.col("label") != "3")), "all")
    pred = SC.nearest_prototype(v, protos, carry=("label",))
    return E.unknown_counts(pred, protos)


@query("e4_full_eval", sql=f"""
select round(avg(CAST(label = pred AS DOUBLE)), 6) as acc, count(*) as n from ({NEAREST_VEC()})
""")
def e4_full_eval(spark, d):
    a = E.accuracy(proto_eval.nearest_predictions(views.vec(spark, d), 5))
    return a.select(F.round("acc", 6).alias("acc"), "n")


RUNS = f"""
with v as ({VEC}), x as (select v.*, r.run from v, (select unnest(range(0, 5)) as run) r),
s as (select * from (select *, row_number() over (partition by run, label order by {H('run-shot', 'run', 'uid')}, uid) as rn from x) where rn <= 5),
pe as (select run, label, dim, avg(x) as x from (select run, label, unnest(range(len(vec))) as dim, CAST(unnest(vec) AS DOUBLE) as x from s) group by run, label, dim),
p as (select run, label, list(x order by dim) as proto from pe group by run, label),
q as (select * from x where (run, uid) not in (select (run, uid) from s)),
pr as (select q.run, q.uid, q.label, arg_min(p.label, struct_pack(d := round(list_distance(CAST(q.vec AS DOUBLE[]), p.proto), 9), c := p.label)) as pred
       from q join p on q.run = p.run group by q.run, q.uid, q.label),
acc as (select run, avg(CAST(label = pred AS DOUBLE)) as acc, count(*) as n from pr group by run)
"""


@query("e5_run_summary", sql=RUNS + "select CAST(run AS INTEGER) as run, round(acc, 6) as acc, n from acc")
def e5_run_summary(spark, d):
    pr = proto_eval.run_predictions(views.vec(spark, d), 5, runs=5)
    return E.accuracy(pr, by=("run",)).select(F.col("run").cast("int").alias("run"), F.round("acc", 6).alias("acc"), "n")


@query("a9_run_summary", sql=RUNS + """
select round(avg(acc), 6) as mean, round(stddev_pop(acc), 6) as std, count(*) as count from acc
""")
def a9_run_summary(spark, d):
    pr = proto_eval.run_predictions(views.vec(spark, d), 5, runs=5)
    return E.mean_std(E.accuracy(pr, by=("run",)), "acc")


@query("w16_eval_batches", sql=f"""
select uid, CAST((row_number() over (order by {H('batch', 'uid')}, uid) - 1) // 40 AS BIGINT) as batch
from ({NEAREST_VEC()})
""")
def w16_eval_batches(spark, d):
    return eval_batches(proto_eval.nearest_predictions(views.vec(spark, d), 5), 40).select("uid", "batch")


@query("a14_batch_mean", sql=f"""
with b as (select *, (row_number() over (order by {H('batch', 'uid')}, uid) - 1) // 40 as batch from ({NEAREST_VEC()})),
m as (select batch, avg(CAST(label = pred AS DOUBLE)) as a from b group by batch)
select round(avg(a), 6) as mean_of_batches, count(*) as batches from m
""")
def a14_batch_mean(spark, d):
    b = eval_batches(proto_eval.nearest_predictions(views.vec(spark, d), 5), 40)
    b = b.withColumn("hit", (F.col("label") == F.col("pred")).cast("double"))
    return E.batch_mean(b, "hit", "batch")


@query("w18_running_best", sql=f"""
with b as (select row_number() over (order by {H('batch', 'uid')}, uid) - 1 as episode,
                  CAST(label = pred AS DOUBLE) as acc from ({NEAREST_VEC()})),
r as (select episode, avg(acc) over (order by episode rows between unbounded preceding and current row) as running from b),
s as (select * from r where episode % 100 = 99)
select CAST(episode AS BIGINT) as episode, round(running, 6) as running,
       running >= max(running) over (order by episode rows between unbounded preceding and current row) as is_best from s
""")
def w18_running_best(spark, d):
    b = eval_batches(proto_eval.nearest_predictions(views.vec(spark, d), 5), 1)
    trace = b.select((F.col("rn") - 1).alias("episode"), (F.col("label") == F.col("pred")).cast("double").alias("acc"))
    return E.running_best(trace, "episode", "acc", every=100)


@query("w19_label_ranking", sql=f"""
select uid, label, round(score, 6) as score,
       CAST(row_number() over (partition by uid order by score desc, label) AS BIGINT) as rank
from ({DIST_SCORES()})
""")
def w19_label_ranking(spark, d):
    s = proto_eval.distance_scores(views.vec(spark, d), 5)
    r = SC.label_ranking(s, higher_is_better=True)
    return r.select("uid", "label", F.round("score", 6).alias("score"), "rank")


@query("w19_label_ranking_blocks", sql=f"""
select uid, label, round(score, 6) as score,
       CAST(row_number() over (partition by uid order by score desc, label) AS BIGINT) as rank
from ({DIST_SCORES()})
""")
def w19_label_ranking_blocks(spark, d):
    s = proto_eval.distance_scores(views.vec(spark, d), 5, block_bytes=2048)
    return SC.label_ranking(s).select("uid", "label", F.round("score", 6).alias("score"), "rank")


@query("w19_top3_accuracy", sql=f"""
with r as (select *, row_number() over (partition by uid order by score desc, label) as rank from ({DIST_SCORES()}))
select round(avg(CAST(hit AS DOUBLE)), 6) as top3_acc, count(*) as n from
  (select uid, max(CAST(label = truth AS INTEGER)) as hit from r where rank <= 3 group by uid)
""")
def w19_top3_accuracy(spark, d):
    s = proto_eval.distance_scores(views.vec(spark, d), 5)
    r = SC.label_ranking(s, higher_is_better=True, top=3)
    hit = r.groupBy("uid").agg(F.max((F.col("label") == F.col("truth")).cast("int")).alias("hit"))
    return hit.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("top3_acc"), F.count(F.lit(1)).alias("n"))


@query("a10_group_softmax", sql=f"""
select uid, label, round(e / sum(e) over (partition by uid), 6) as prob from
  (select *, exp(score - max(score) over (partition by uid)) as e from ({DIST_SCORES()}))
""")
def a10_group_softmax(spark, d):
    s = proto_eval.distance_scores(views.vec(spark, d), 5)
    return SC.group_softmax(s).select("uid", "label", F.round("prob", 6).alias("prob"))


@query("x26_log_loss", sql=f"""
with s as ({DIST_SCORES()}),
e as (select *, exp(score - max(score) over (partition by uid)) as e from s),
p as (select *, e / sum(e) over (partition by uid) as prob from e)
select round(avg(-ln(prob)), 6) as log_loss, count(*) as n from p where label = truth
""")
def x26_log_loss(spark, d):
    s = SC.group_softmax(proto_eval.distance_scores(views.vec(spark, d), 5))
    return E.log_loss(s)


@query("x26_log_loss_underflow", sql=f"""
with s as ({DIST_SCORES()}),
e as (select *, exp(800 * (score - max(score) over (partition by uid))) as e from s),
p as (select *, e / sum(e) over (partition by uid) as prob from e),
q as (select uid, max(case when label = truth and label <> '3' then prob end) as prob from p where label <> '3' group by uid)
select round(avg(case when prob is not null then -ln(greatest(prob, 2.2250738585072014e-308)) end), 6) as log_loss, count(prob) as n, count(*) - count(prob) as n_unknown from q
""")
def x26_log_loss_underflow(spark, d):
    """Scores sharpened until probabilities underflow, and label 3 no candidate: nothing may be lost."""
    s = proto_eval.distance_scores(views.vec(spark, d), 5).withColumn("score", F.col("score") * 800)
    return E.log_loss_known(SC.group_softmax(s).where(F.col("label") != "3"))


FOLDS = f"""
with v as (select *, CAST({HINT('uid')} % 10 + 1 AS INTEGER) as fold from ({VEC})),
s as (select * from (select *, row_number() over (partition by fold, label order by {H('fold-shot', 'fold', 'uid')}, uid) as rn from v) where rn <= 5),
pe as (select fold, label, dim, avg(x) as x from (select fold, label, unnest(range(len(vec))) as dim, CAST(unnest(vec) AS DOUBLE) as x from s) group by all),
p as (select fold, label, list(x order by dim) as proto from pe group by fold, label),
q as (select * from v where (fold, uid) not in (select (fold, uid) from s)),
pr as (select q.fold, q.uid, q.label, arg_min(p.label, struct_pack(d := round(list_distance(CAST(q.vec AS DOUBLE[]), p.proto), 9), c := p.label)) as pred
       from q join p on q.fold = p.fold group by all),
acc as (select fold, avg(CAST(label = pred AS DOUBLE)) as acc, count(*) as n from pr group by fold)
"""


@query("e5_fold_summary", sql=FOLDS + """
select round(avg(acc), 6) as mean, round(stddev_pop(acc), 6) as std, count(*) as count from acc
""")
def e5_fold_summary(spark, d):
    pr = proto_eval.fold_predictions(views.vec(spark, d), 5, folds=10)
    return E.mean_std(E.accuracy(pr, by=("fold",)), "acc")
