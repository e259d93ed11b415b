"""Entailment-style few-shot classification end to end.

Training table: pairs of the seen train part and of the novel support are
built separately (each row against the labels of its own subset), the train
pairs are negative-sampled, then combined by training mode (F9).

Inference: every test row of the scope against every label of the scope's
support set, a pair scorer, best label per row, report.  The built-in scorer
is the cosine between the hashed bag of words of the text and the label's
support prototype (mean of its support rows' vectors); ``models`` offers a
learned pair classifier as the alternative scorer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.operators import encode as EN
from intentloom.operators import evaluate as E
from intentloom.operators import models as MD
from intentloom.operators import pairs as P
from intentloom.operators import score as SC
from intentloom.operators import split as S
from intentloom.operators.joins import checked_broadcast
from intentloom.session import materialize


def training_table(split: DataFrame, k: int = 5, ratio: int = 2, seen_class_data: str = "yes") -> DataFrame:
    train = split.where(F.col("part") == "train_seen").select("uid", "label").withColumn("origin", F.lit("train"))
    sup = (split.where((F.col("part") == "support_novel") & (F.col("k") == k)).select("uid", "label")
           .withColumn("origin", F.lit("support")))
    tp = P.sample_negatives(P.entailment_pairs(train, scope="origin"), ratio=ratio, positives=P.entailment_positives(train))
    sp = P.entailment_pairs(sup, scope="origin")
    return P.train_mode(tp, sp, k, seen_class_data)


def inference_pairs(split: DataFrame, scope: str = "joint", k: int = 5) -> DataFrame:
    """Each test row of the scope x each label of the scope's support."""
    test, sup = S.eval_scope(split, scope, k)
    t = test.select("uid", "label").withColumn("origin", F.lit(scope))
    c = sup.select("label").withColumn("origin", F.lit(scope))
    return P.entailment_pairs(t, scope="origin", candidates=c)


def cosine_predictions(split: DataFrame, scope: str = "joint", k: int = 5, dim: int = 64) -> DataFrame:
    """``(uid, label, pred, score)``: best support prototype by cosine of
    hashed bag-of-words vectors (queries without tokens score -2 everywhere
    and take the lowest label)."""
    test, sup = S.eval_scope(split, scope, k)
    sv = EN.hash_encode(sup.select("uid", "utterance"), dim).join(sup.select("uid", "label"), "uid")
    protos = SC.prototypes(sv).select("label", F.col("proto").alias("lvec"))
    tv = test.select("uid", "label", "utterance").join(EN.hash_encode(test.select("uid", "utterance"), dim), "uid", "left")
    best = SC.zero_shot_cosine(SC.with_scope(tv, "all"), SC.with_scope(protos, "all"), carry=("label",))
    return best.withColumn("score", F.round("score", 6))


def cosine_report(split: DataFrame, scope: str = "joint", k: int = 5) -> DataFrame:
    return E.class_report(cosine_predictions(split, scope, k))


def _fitted(split: DataFrame, scope: str, k: int, dim: int):
    """The pair classifier (M2) fitted on the training table, the scope's test vectors and its support's label vectors.

    Fitting reads its rows several times (size of the features, moments, blocks), so the training table and the vectors are
    written once: no pass draws pairs or splits texts again."""
    train = materialize(training_table(split, k), "pairs")
    test, sup = S.eval_scope(split, scope, k)
    texts = split.where((F.col("part") == "train_seen") | ((F.col("part") == "support_novel") & (F.col("k") == k)))
    tv = materialize(EN.hash_encode(texts.select("uid", "utterance"), dim), "vectors").withColumnRenamed("vec", "tvec")
    names = train.select("label_name").unionByName(sup.select(F.col("label").alias("label_name"))).distinct()
    lv = EN.hash_encode(names.withColumn("uid", F.col("label_name")), dim, text="label_name").select(
        F.col("uid").alias("label_name"), F.col("vec").alias("lvec"))
    lv = checked_broadcast(lv)
    model = MD.pair_classifier(MD.pair_features(train.join(tv, "uid").join(lv, "label_name")))
    qv = materialize(EN.hash_encode(test.select("uid", "utterance"), dim), "vectors").join(test.select("uid", F.col("label").alias("truth")), "uid")
    cands = SC.with_scope(sup.select("label").distinct().join(lv.withColumnRenamed("label_name", "label"), "label"), "all")
    return model, SC.with_scope(qv, "all"), cands


def classifier_scores(split: DataFrame, scope: str = "joint", k: int = 5, dim: int = 64) -> DataFrame:
    """``(uid, truth, label_name, score)``: the pair classifier over every test row of the scope and every
    label of its support, one row per pair (for rankings; ``classifier_predictions`` emits no pairs)."""
    model, qv, cands = _fitted(split, scope, k, dim)
    pairs = SC.pair_scores(qv, cands, lambda c: c["lvec"]).select(
        "uid", "truth", F.col("label").alias("label_name"), F.col("vec").alias("tvec"), F.col("score").alias("lvec"))
    return MD.entail_prob(model, pairs).select("uid", "truth", "label_name", "score")


def classifier_predictions(split: DataFrame, scope: str = "joint", k: int = 5, dim: int = 64, block_bytes: int | None = None) -> DataFrame:
    """``(uid, label, pred, score)``: the label of the support that the fitted pair classifier holds most likely entailed,
    for every test row of the scope, judged in its own row."""
    model, qv, cands = _fitted(split, scope, k, dim)
    best = MD.best_entailed(qv, cands, *MD.pair_weights(model), carry=("truth",), block_bytes=block_bytes)
    return best.withColumnRenamed("truth", "label")


def classifier_report(split: DataFrame, scope: str = "joint", k: int = 5) -> DataFrame:
    """E1 of the fitted entailment model over every test row of the scope."""
    return E.class_report(classifier_predictions(split, scope, k))
