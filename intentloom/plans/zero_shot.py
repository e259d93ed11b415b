"""Zero-shot label scoring: each query against the vector of every candidate
label *name*, best cosine wins (no support rows needed), and the same pairs as
a long ``(query, label)`` table for a pluggable pair scorer.

Query vectors: mean of the query's word vectors; label vectors: vector of the
lower-cased label name.  Word vectors come from ``hashed_word_vectors`` (any
word -> an embedding row), standing in for a pretrained table.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.operators import encode as EN
from intentloom.operators import score as SC
from intentloom.operators.joins import checked_broadcast


def _vectors(utts: DataFrame, emb: DataFrame):
    t = utts.select("uid", F.explode(EN.bow_tokens("utterance")).alias("word"))
    lw = utts.select("label").distinct().withColumn("word", F.lower("label"))
    wv = checked_broadcast(EN.hashed_word_vectors(t.select("word").unionByName(lw.select("word")), emb))
    # each distinct word of a text meets its vector once; the mean is weighted by its count
    c = t.groupBy("uid", "word").agg(F.count(F.lit(1)).cast("double").alias("__n"))
    known = (c.join(wv, "word").groupBy("uid")
          .agg(Summarizer.mean(array_to_vector(V.as_double("vec")), F.col("__n")).alias("__m"))
          .select("uid", vector_to_array("__m").alias("vec")))
    # a text without a known word stays, with a NULL vector (score -2)
    qv = utts.select("uid", "label").join(known, "uid", "left")
    lv = lw.join(wv, "word").select("label", V.as_double("vec").alias("lvec"))
    return qv, lv


def predictions(spark: SparkSession, utts: DataFrame, emb: DataFrame, index: bool = False) -> DataFrame:
    """J7 + W6: ``(uid, label, pred, score)``; ``index`` for large label sets."""
    qv, lv = _vectors(utts, emb)
    best = SC.zero_shot_cosine(SC.with_scope(qv, "all"), SC.with_scope(lv, "all"), carry=("label",), index=index)
    return best.withColumn("score", F.round("score", 6))


def pair_table(spark: SparkSession, utts: DataFrame, emb: DataFrame) -> DataFrame:
    """``(uid, truth, label_name, score)``: one row per query and candidate
    label, score = cosine (NULL-safe, -2 for a zero vector)."""
    qv, lv = _vectors(utts, emb)
    q = SC.with_scope(qv.withColumnRenamed("label", "truth"), "all")
    s = SC.pair_scores(q, SC.with_scope(lv, "all"),
                       lambda c: F.round(F.coalesce(V.cosine("vec", c["lvec"]), F.lit(-2.0)), 9))
    return s.select("uid", "truth", F.col("label").alias("label_name"), "score")
