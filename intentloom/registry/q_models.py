"""Proofs for model plug points (rows-only checks: model output is not SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.operators import encode as EN
from intentloom.operators import evaluate as E
from intentloom.operators import models as MD
from intentloom.operators import pairs as P
from intentloom.operators import score as SC
from intentloom.operators import split as S
from intentloom.plans import nli, split_build
from intentloom.registry import query
from intentloom.registry.sqlparts import BOW_TOKENS, HINT, SPLIT, UTT, UTT_LANG
from intentloom.session import materialize
from intentloom.sources import views


@query("p1_encode_batch", sql=f"""
select uid, CAST({HINT('t')} % 64 AS INTEGER) as dim, CAST(count(*) AS DOUBLE) as value from
  (select uid, unnest({BOW_TOKENS('utterance')}) as t from ({UTT})) group by all
""")
def p1_encode_batch(spark, d):
    """The plug-in's vectors, entry by entry (zeros left out)."""
    v = MD.encode(views.utt(spark, d), MD.numpy_hash_encoder(64), dim=64)
    return v.select("uid", F.posexplode("vec").alias("dim", "value")).where("value <> 0").select("uid", "dim", F.col("value").cast("double").alias("value"))


@query("p1_length_batches", sql=f"""
with t as (select uid, unnest({BOW_TOKENS('utterance')}) as t from ({UTT}))
select uid, CAST({HINT('t')} % 64 AS INTEGER) as dim, CAST(count(*) AS DOUBLE) as value from t group by all
""")
def p1_length_batches(spark, d):
    """The plug-in in batches of texts of like length within a padding budget: the same vectors, whatever the batches."""
    v = MD.encode_by_length(views.utt(spark, d), MD.numpy_hash_encoder(64), dim=64)
    return v.select("uid", F.posexplode("vec").alias("dim", "value")).where("value <> 0").select("uid", "dim", F.col("value").cast("double").alias("value"))


@query("m1_seen_classifier")
def m1_seen_classifier(spark, d):
    sp, _ = split_build.build(views.utt_lang(spark, d), m=1, materialized=True)
    train = sp.where(F.col("part") == "train_seen")
    model = MD.seen_classifier(train)
    return MD.classify(model, sp.where(F.col("part") == "test_seen"))


@query("m1_report_support", sql=f"""
with sp as ({SPLIT(UTT_LANG, m=1)}), t as (select label from sp where part = 'test_seen')
select label, count(*) as support, true as known from t group by label
union all select 'accuracy', count(*), true from t union all select 'macro avg', count(*), true from t union all select 'weighted avg', count(*), true from t
""")
def m1_report_support(spark, d):
    """The classifier's report (E1): every test row is judged, and only labels that were learned are predicted."""
    sp, _ = split_build.build(views.utt_lang(spark, d), m=1, materialized=True)
    train = sp.where(F.col("part") == "train_seen")
    got = materialize(MD.classify(MD.seen_classifier(train), sp.where(F.col("part") == "test_seen")))
    strange = got.join(F.broadcast(train.select(F.col("label").alias("pred")).distinct()), "pred", "left_anti").select(F.count(F.lit(1)) == 0).scalar()
    rep = E.class_report(got)
    sane = rep.select(F.min(F.coalesce(F.col("f1").between(0, 1), F.lit(False)))).scalar()
    return rep.where(F.col("support") > 0).select("label", "support", (strange & sane).alias("known"))


@query("m2_novel_predictions", sql=f"""
with sp as ({SPLIT(UTT)}), t as (select uid, label from sp where part in ('test_seen', 'test_novel')),
c as (select count(distinct label) as n from sp where part in ('support_seen', 'support_novel') and k = 5)
select uid, label, true as is_candidate, n as n_scores from t, c
""")
def m2_novel_predictions(spark, d):
    """Entailment inference with the fitted pair classifier: every test row against every label of the joint support."""
    sp, _ = split_build.build(views.utt(spark, d), materialized=True)
    scored = materialize(nli.classifier_scores(sp, "joint", 5))
    best = SC.best_from_scores(scored.select("uid", F.col("label_name").alias("label"), "score"))
    n = scored.where(F.col("score").between(0, 1)).groupBy("uid", F.col("truth").alias("label")).agg(
        F.count(F.lit(1)).alias("n_scores"), F.collect_set("label_name").alias("names"))
    return n.join(best, "uid").select("uid", "label", F.array_contains("names", F.col("pred")).alias("is_candidate"), "n_scores")


@query("m2_classifier_report")
def m2_classifier_report(spark, d):
    """The report of the fitted entailment model over every test row of the joint scope, without emitting a pair."""
    sp, _ = split_build.build(views.utt(spark, d), materialized=True)
    return nli.classifier_report(sp, "joint", 5)


# weights in eighths: every sum is exact, so the two engines' probabilities agree to the last digit that counts
PAIR_WEIGHTS = [((i * m) % 13 - 6) / 8 for m in (5, 7, 11, 3) for i in range(64)]


@query("m2_row_scores", sql=f"""
with sp as ({SPLIT(UTT)}), t as (select uid, label, utterance from sp where part in ('test_seen', 'test_novel')),
c as (select distinct label as cand from sp where part in ('support_seen', 'support_novel') and k = 5),
te as (select uid, CAST({HINT('w')} % 64 AS BIGINT) as i, CAST(count(*) AS DOUBLE) as a from (select uid, unnest({BOW_TOKENS('utterance')}) as w from t) group by all),
ce as (select cand, CAST({HINT('w')} % 64 AS BIGINT) as i, CAST(count(*) AS DOUBLE) as b from (select cand, unnest({BOW_TOKENS('cand')}) as w from c) group by all),
w as (select i, ((i * 5) % 13 - 6) / 8.0::double as w1, ((i * 7) % 13 - 6) / 8.0::double as w2, ((i * 11) % 13 - 6) / 8.0::double as w3, ((i * 3) % 13 - 6) / 8.0::double as w4 from range(64) r(i)),
td as (select t.uid, w.i, coalesce(te.a, 0.0::double) as a from t cross join w left join te on te.uid = t.uid and te.i = w.i),
cd as (select c.cand, w.*, coalesce(ce.b, 0.0::double) as b from c cross join w left join ce on ce.cand = c.cand and ce.i = w.i),
m as (select uid, cand, sum(w1 * a + w2 * b + w3 * abs(a - b) + w4 * a * b) + 0.25::double as z from td join cd using (i) group by uid, cand),
p as (select uid, cand, round(1 / (1 + exp(-z)), 9) as s from m)
select t.uid, t.label, arg_min(cand, struct_pack(ns := -s, c := cand)) as pred, round(max(s), 6) as score from p join t using (uid) group by all
""")
def m2_row_scores(spark, d):
    """P2 in the row with given weights over [a; b; |a-b|; a*b]: every test row against every label of the joint support."""
    sp, _ = split_build.build(views.utt(spark, d), materialized=True)
    test, sup = S.eval_scope(sp, "joint", 5)
    q = test.select("uid", "label").join(EN.hash_encode(test.select("uid", "utterance")), "uid")
    c = EN.hash_encode(sup.select("label").distinct(), text="label", key="label").withColumnRenamed("vec", "lvec")
    best = MD.best_entailed(SC.with_scope(q, "all"), SC.with_scope(c, "all"), PAIR_WEIGHTS, 0.25, carry=("label",))
    return best.withColumn("score", F.round("score", 6))


@query("m2_pair_classifier")
def m2_pair_classifier(spark, d):
    sp, _ = split_build.build(views.part_utt(spark, d), m=2, materialized=True)
    train = sp.where(F.col("part") == "train_seen").select("uid", "utterance", "label").withColumn("origin", F.lit("t"))
    tv = EN.hash_encode(train, 64).withColumnRenamed("vec", "tvec")
    pairs = P.sample_negatives(P.entailment_pairs(train, scope="origin"), positives=P.entailment_positives(train))
    lv = EN.hash_encode(pairs.select(F.col("label_name").alias("uid"), F.col("label_name").alias("utterance"))
                        .distinct(), 64).select(F.col("uid").alias("label_name"), F.col("vec").alias("lvec"))
    feats = MD.pair_features(pairs.join(tv, "uid").join(lv, "label_name"))
    model = MD.pair_classifier(feats)
    test = sp.where(F.col("part") == "test_seen").select("uid", "utterance", "label").withColumn("origin", F.lit("t"))
    tp = P.entailment_pairs(test, scope="origin")
    tt = EN.hash_encode(test, 64).withColumnRenamed("vec", "tvec")
    scored = MD.entail_prob(model, tp.join(tt, "uid").join(lv, "label_name"))
    best = SC.best_from_scores(scored.select("uid", F.col("label_name").alias("label"), "score"))
    return test.select("uid", "label").join(best, "uid")
