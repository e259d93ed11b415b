"""Prototype classification end to end (the minimum slice):

vectors -> K-shot support per label -> class prototypes -> nearest prototype
for every non-support row -> classification report.

Shuffles: the support top-K (partial limit before the exchange) and the
prototype aggregate (partial); the support (labels x K rows) is written once for
the prototypes and the anti join; the prototypes (labels x d) travel as
size-checked arrays and every other row, with its label, is scored in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.functions.order import hash_int, seeded_key
from intentloom.operators import evaluate, score, split
from intentloom.operators.rank import group_top
from intentloom.session import materialize


def support_of(vecs: DataFrame, k: int) -> DataFrame:
    return split.kshot_support(vecs, k).drop("rn")


def prototypes_of(support: DataFrame) -> DataFrame:
    return score.prototypes(support)


def _support_and_rest(vecs: DataFrame, k: int):
    # K rows per label: bounded, written once for the prototypes and the anti join
    sup = materialize(support_of(vecs, k), "support")
    return sup, score.with_scope(vecs.join(sup.select("uid"), "uid", "left_anti"), "all")


def nearest_predictions(vecs: DataFrame, k: int = 5, block_bytes: int | None = None, index: bool = False) -> DataFrame:
    """``(uid, label, pred, score)`` for every row not drawn as support; ``index`` for large label sets."""
    sup, queries = _support_and_rest(vecs, k)
    best = score.nearest_prototype(queries, score.with_scope(prototypes_of(sup), "all"), carry=("label",), block_bytes=block_bytes, index=index)
    return best.withColumn("score", F.round("score", 6))


def report(vecs: DataFrame, k: int = 5) -> DataFrame:
    return evaluate.class_report(nearest_predictions(vecs, k))


def distance_scores(vecs: DataFrame, k: int = 5, block_bytes: int | None = None) -> DataFrame:
    """Long form ``(uid, truth, label, score)``: score = minus the Euclidean
    distance of a non-support row to each prototype (logits of X7)."""
    sup, queries = _support_and_rest(vecs, k)
    protos = score.with_scope(prototypes_of(sup), "all")
    s = score.pair_scores(queries.select("uid", F.col("label").alias("truth"), "scope", "vec"),
                          protos.select("scope", "label", "proto"),
                          lambda c: -F.round(V.l2_dist("vec", c["proto"]), 9), block_bytes=block_bytes)
    return s.drop("vec")


def _scoped_predictions(x: DataFrame, scope: str, salt: str, k: int) -> DataFrame:
    """K support rows per label and ``scope``; the scope's other rows are scored in place against its prototypes."""
    h = x.withColumn("__h", seeded_key(scope, "uid", salt=salt))
    sup = materialize(group_top(h, [scope, "label"], [F.col("__h"), F.col("uid")], k).drop("__h", "rn"), "support")
    rest = x.join(sup.select(scope, "uid"), [scope, "uid"], "left_anti")
    best = score.nearest_prototype(rest, score.prototypes(sup, by=(scope, "label")), scope_col=scope, carry=(scope, "label"))
    return best.select(scope, "uid", "label", "pred")


def run_predictions(vecs: DataFrame, k: int = 5, runs: int = 5) -> DataFrame:
    """The whole prototype evaluation repeated for ``runs`` seeds in
    one job; the seed is part of the support draw's hash.  Returns
    ``(run, uid, label, pred)``."""
    return _scoped_predictions(vecs.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))), "run", "run-shot", k)


def fold_predictions(vecs: DataFrame, k: int = 5, folds: int = 10) -> DataFrame:
    """E5 over folds: rows fall into ``folds`` folds by a stable hash; inside
    each fold, K support rows per label make the prototypes and the fold's
    other rows are classified.  Returns ``(fold, uid, label, pred)``."""
    return _scoped_predictions(vecs.withColumn("fold", (hash_int("uid") % folds + 1).cast("int")), "fold", "fold-shot", k)
