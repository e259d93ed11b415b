"""Scoring: prototypes, nearest prototype, zero-shot cosine, label ranking,
group softmax, pair scoring, dispersion and query-attentive prototypes.

Candidate labels (prototypes, label-name vectors) travel as arrays of bounded
bytes (scalar subqueries, computed once), and every query is scored inside its
own row against the labels of its scope: no query x label join, no shuffle of
query rows.  More candidates than a block holds take further passes over the
rows; results are the same at every size.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.operators import metric_index as MI
from intentloom.operators.joins import best_candidate, candidate_blocks, each_candidate

TIE_DIGITS = 9  # distances are rounded before comparing so ties are engine-independent


def prototypes(support: DataFrame, by=("label",), vec: str = "vec", out: str = "proto") -> DataFrame:
    """Element-wise mean vector per group.

    Uses ``Summarizer.mean`` on ML vectors: one d-wide buffer per group with
    partial aggregation before the shuffle, no explode to n x d rows.
    """
    by = list(by)
    x = support.select(*by, array_to_vector(V.as_double(vec)).alias("__v"))
    agg = x.groupBy(*by).agg(Summarizer.mean(F.col("__v")).alias("__m"), F.count(F.lit(1)).alias("n_support"))
    return agg.select(*by, vector_to_array("__m").alias(out), "n_support")


def with_scope(df: DataFrame, scope: str | None) -> DataFrame:
    return df if scope in df.columns else df.withColumn("scope", F.lit(scope or "all"))


def _best(queries: DataFrame, cands: DataFrame, score_of, smaller_is_better: bool, scope_col: str,
          key: str, vec: str, carry, block_bytes) -> DataFrame:
    """The best candidate of each query's scope.  ``array_min`` compares (order, label) structs field
    by field, so ties go to the lowest label."""
    carry = [c for c in carry if c != key]
    q = queries.select(*dict.fromkeys([key, *carry, scope_col, vec]))

    def choose(arr):
        mine = F.filter(arr, lambda c: c[scope_col] == F.col(scope_col))
        order = (lambda c: score_of(c)) if smaller_is_better else (lambda c: -score_of(c))
        return F.array_min(F.transform(mine, lambda c: F.struct(order(c).alias("o"), c["label"].alias("label"))))

    b = best_candidate(q, candidate_blocks(cands, cands.columns, block_bytes, scope_col), choose, by=scope_col)
    found = F.col("__best.o") if smaller_is_better else -F.col("__best.o")
    return b.select(key, *carry, F.col("__best.label").alias("pred"), found.alias("score"))


def nearest_prototype(queries: DataFrame, protos: DataFrame, scope_col: str = "scope",
                      key: str = "uid", vec: str = "vec", proto: str = "proto", carry=(),
                      block_bytes: int | None = None, index: bool = False) -> DataFrame:
    """J6 + W6: Euclidean distance of each query to every prototype of its scope;
    predicted label = smallest distance, ties to the lowest label.  ``index`` (for large label sets)
    measures only the prototypes that the triangle inequality leaves open (``metric_index``): the same rows.

    Returns ``(key, carry..., pred, score)``, one row per query row: repeated keys stay apart, and a
    query whose scope has no candidate gets a NULL prediction.
    """
    p = protos.select(scope_col, F.col("label"), F.col(proto).alias("__p"))
    if index:
        near = MI.nearest(queries, p, lambda c: F.round(V.l2_dist(vec, c["__p"]), TIE_DIGITS), lambda d: d, scope_col, key, vec, carry=carry, block_bytes=block_bytes)
        return near.withColumnRenamed("order", "score").drop("visited", "balls")
    return _best(queries, p, lambda c: F.round(V.l2_dist(vec, c["__p"]), TIE_DIGITS), True, scope_col, key, vec, carry, block_bytes)


def zero_shot_cosine(queries: DataFrame, label_vecs: DataFrame, scope_col: str = "scope",
                     key: str = "uid", vec: str = "vec", lvec: str = "lvec", carry=(),
                     block_bytes: int | None = None, index: bool = False) -> DataFrame:
    """J7 + W6: cosine of each query to every label-name vector of its scope;
    best = largest cosine (a zero or NULL vector scores -2), ties to the lowest label.
    Rows and ``index`` as in ``nearest_prototype``."""
    p = label_vecs.select(scope_col, F.col("label"), F.col(lvec).alias("__l"))
    score_of = lambda c: F.round(F.coalesce(V.cosine(vec, c["__l"]), F.lit(-2.0)), TIE_DIGITS)
    if index:
        near = MI.nearest(queries, p.withColumn("__p", MI.unit("__l")), lambda c: -score_of(c), lambda d: d * d / 2 - 1, scope_col, key, vec,
                          point=MI.unit(vec), carry=carry, block_bytes=block_bytes)
        return near.withColumn("score", -F.col("order")).drop("order", "visited", "balls")
    return _best(queries, p, score_of, False, scope_col, key, vec, carry, block_bytes)


def pair_scores(queries: DataFrame, cands: DataFrame, scorer, scope_col: str = "scope",
                key: str = "uid", cand_cols=None, block_bytes: int | None = None) -> DataFrame:
    """Long form ``(key, label, score)`` of every query against the candidate
    labels of its scope.  ``scorer(c)`` builds the score Column from the
    candidate struct ``c`` (fields: label and ``cand_cols``) and the query's
    columns.  Candidates come in bounded blocks and are exploded
    per query (a generator, not a join)."""
    cand_cols = list(cand_cols or [c for c in cands.columns if c not in (scope_col, "label")])
    keep = [c for c in queries.columns if c != scope_col]
    return each_candidate(queries, candidate_blocks(cands, [scope_col, "label", *cand_cols], block_bytes, scope_col),
                          lambda a: F.transform(F.filter(a, lambda c: c[scope_col] == F.col(scope_col)),
                                                lambda c: F.struct(c["label"].alias("label"), scorer(c).alias("score"))),
                          lambda x: x.select(*keep, "__c.label", "__c.score"), scope_col)


def label_ranking(scores: DataFrame, key: str = "uid", higher_is_better: bool = True,
                  top: int | None = None) -> DataFrame:
    """Rank of every candidate label per query (score order, then label).

    With ``top`` the rank filter sits on ``row_number()`` so a partial
    WindowGroupLimit trims rows before the shuffle.
    """
    sc = F.col("score").desc() if higher_is_better else F.col("score").asc()
    w = Window.partitionBy(key).orderBy(sc, F.col("label"))
    r = scores.withColumn("rank", F.row_number().over(w))
    if top is not None:
        r = r.where(F.col("rank") <= top)
    return r.withColumn("rank", F.col("rank").cast("long"))


def group_softmax(scores: DataFrame, key: str = "uid", score: str = "score", out: str = "prob") -> DataFrame:
    """A10: softmax of scores within each query group, max-shifted for stability.

    Group = one query's candidate labels (bounded by the label count)."""
    w = Window.partitionBy(key)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn("__e", e).withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def best_from_scores(scores: DataFrame, key: str = "uid", higher_is_better: bool = True) -> DataFrame:
    """W6 over a long score table: ``(key, pred, score)``; ties to the lowest label."""
    s = F.round(F.col("score"), TIE_DIGITS)
    order = F.struct((-s) if higher_is_better else s, F.col("label"))
    return scores.groupBy(key).agg(F.min_by("label", order).alias("pred"),
                                   (F.max(s) if higher_is_better else F.min(s)).alias("score"))


def dispersion(support: DataFrame, protos: DataFrame, by=("label",), vec: str = "vec",
               proto: str = "proto") -> DataFrame:
    """Mean squared distance of support vectors to their class vector,
    per group and (``by`` empty) overall."""
    by = list(by)
    j = support.join(protos.select(*by, proto), by)
    return j.groupBy(*by).agg(F.avg(V.sq_dist(vec, proto)).alias("dispersion"))


def attentive_prototypes(queries: DataFrame, support: DataFrame, by=("episode", "class_id"),
                         qkey: str = "q_uid", vec: str = "vec") -> DataFrame:
    """Query-conditioned class vector.

    For each query and class of its group ``by[:-1]`` (e.g. an episode):
    weights = softmax over the class's support rows of ``sum(tanh(s * q))``,
    class vector = sum of weights x support vectors.  Support per class is
    bounded by K; the join is an equi-join on the group key.
    """
    by = list(by)
    grp = by[:-1]
    q = queries.select(*grp, qkey, F.col(vec).alias("__q"))
    s = support.select(*by, F.col("uid").alias("__s_uid"), F.col(vec).alias("__s"))
    j = q.join(s, grp)
    att = V.vsum(F.zip_with("__s", "__q", lambda a, b: F.tanh(a.cast("double") * b.cast("double"))))
    w = Window.partitionBy(*grp, qkey, by[-1])
    j = j.withColumn("__a", att).withColumn("__e", F.exp(F.col("__a") - F.max("__a").over(w)))
    j = j.withColumn("__w", F.col("__e") / F.sum("__e").over(w))
    j = j.select(*by, qkey, array_to_vector(V.vscale("__s", F.col("__w"))).alias("__wv"))
    agg = j.groupBy(*by, qkey).agg(Summarizer.sum(F.col("__wv")).alias("__v"))
    return agg.select(*by, qkey, vector_to_array("__v").alias("proto"))
