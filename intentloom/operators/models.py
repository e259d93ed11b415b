"""Model plug points: a batched text encoder (user model in ``mapInPandas``),
a seen-class classifier and a pair (entailment) classifier built from Spark ML.

The reference fine-tunes transformers on a GPU; here the same table shapes are
served by Spark ML estimators, and any real model plugs into ``encode``:
loaded once per task, fed Arrow batches, never one row per call.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, StringIndexer, Tokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.functions import vectors as V
from intentloom.operators.joins import best_candidate, candidate_blocks
from intentloom.operators.score import TIE_DIGITS


def encode(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
           dim: int, text: str = "utterance", key: str = "uid", out: str = "vec") -> DataFrame:
    """Apply a text encoder to every row, batched.

    ``make_encoder()`` runs once per task (load weights there) and returns a
    function from a list of texts to an ``(n, dim)`` array.  Rows travel as
    Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``).
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        fn = make_encoder()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            m = np.asarray(fn(texts), dtype=np.float32).reshape(len(texts), dim)
            yield pd.DataFrame({key: pdf[key].values, out: list(m)})

    return df.select(key, text).mapInPandas(run, schema)


def encode_by_length(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, budget: int = 8192,
                     text: str = "utterance", key: str = "uid", out: str = "vec") -> DataFrame:
    """P1 with L3: ``encode`` in batches of texts of like length, ``(key, out, batch_rows, batch_width, n_tokens)``.

    Texts are dealt to tasks in ranges of their length and come sorted; a batch takes texts, across Arrow batches, as long as
    rows x longest text stays within ``budget`` tokens (or holds one text).  What padding costs is the share of
    rows x width that is not tokens (``padding_share``).  Rows are keyed, so their order plays no part in the result."""
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(out, T.ArrayType(T.FloatType())), T.StructField("batch_rows", T.IntegerType()),
                           T.StructField("batch_width", T.IntegerType()), T.StructField("n_tokens", T.IntegerType())])
    n = F.size(F.filter(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda t: t != ""))
    rows = df.select(key, text, n.alias("__n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "__n", F.xxhash64(key)).sortWithinPartitions("__n")

    def run(batches):
        fn = make_encoder()

        def encoded(keys, texts, sizes):
            m = np.asarray(fn(texts), dtype=np.float32).reshape(len(texts), dim)
            return pd.DataFrame({key: pd.Series(keys, dtype=object), out: list(m), "batch_rows": np.int32(len(texts)), "batch_width": np.int32(max(sizes)),
                                 "n_tokens": np.array(sizes, np.int32)})

        keys, texts, sizes = [], [], []
        for pdf in batches:
            for k, t, size in zip(pdf[key].tolist(), pdf[text].fillna("").tolist(), pdf["__n"].tolist()):
                if texts and (len(texts) + 1) * max(size, 1) > budget:  # sorted: the new text is the longest
                    yield encoded(keys, texts, sizes)
                    keys, texts, sizes = [], [], []
                keys.append(k)
                texts.append(t)
                sizes.append(size)
        if texts:
            yield encoded(keys, texts, sizes)

    return rows.mapInPandas(run, schema)


def padding_share(encoded: DataFrame) -> DataFrame:
    """One row: rows, tokens, and the share of the batches' rows x width that is padding."""
    return encoded.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"),
                       F.try_divide(F.sum(F.col("batch_width") - F.col("n_tokens")), F.sum("batch_width")).alias("padding"))


def numpy_hash_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A ready encoder factory: lower-cased blank tokens counted into ``dim``
    md5 buckets (same vectors as ``encode.hash_encode``)."""
    def make():
        import hashlib

        def fn(texts):
            m = np.zeros((len(texts), dim), dtype=np.float32)
            for r, t in enumerate(texts):
                for tok in t.lower().strip().split(" "):
                    if tok:
                        h = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim
                        m[r, h] += 1
            return m
        return fn
    return make


def seen_classifier(train: DataFrame, text: str = "utterance", label: str = "label",
                    features: int = 1024, iters: int = 5):
    """M1: Tokenizer -> HashingTF -> IDF -> multinomial logistic regression,
    fitted on the seen training part.  Returns the fitted PipelineModel; its
    ``labels`` metadata maps indices back to names."""
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip"),  # "keep" would add a class of its own
        Tokenizer(inputCol=text, outputCol="__tok"),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=iters, predictionCol="__p"),
    ])
    return pipe.fit(train.where(F.col(text).isNotNull()))


def classify(model, df: DataFrame, key: str = "uid", label: str = "label") -> DataFrame:
    """``(key, label, pred)`` with predicted names from the indexer's labels; a null text is read as empty."""
    text = model.stages[1].getInputCol()  # the column it was fitted on
    names = IndexToString(inputCol="__p", outputCol="pred", labels=model.stages[0].labels)
    judge = PipelineModel([*model.stages[1:], names])  # the truth plays no part
    return judge.transform(df.select(key, label, F.coalesce(F.col(text), F.lit("")).alias(text))).select(key, label, "pred")


def pair_features(pairs: DataFrame, text_vec: str = "tvec", label_vec: str = "lvec") -> DataFrame:
    """X14 features of a (text, label) pair as an ML vector."""
    return pairs.withColumn("features", array_to_vector(V.fuse(text_vec, label_vec)))


def pair_classifier(train_pairs: DataFrame, iters: int = 10):
    """M2: binary logistic regression on fused pair features (``label`` 0/1)."""
    lr = LogisticRegression(featuresCol="features", labelCol="__y", maxIter=iters)
    return lr.fit(train_pairs.withColumn("__y", F.col("label").cast("double")))


def entail_prob(model, pairs: DataFrame, text_vec: str = "tvec", label_vec: str = "lvec") -> DataFrame:
    """P(entailed) per pair as ``score``: the model over X14's features, which are formed of the pair's two vectors a batch at
    a time, not as an ML vector per pair."""
    weights, intercept = pair_weights(model)
    w = np.array(weights).reshape(4, -1)

    @F.arrow_udf("double")
    def prob(text: pa.Array, label: pa.Array) -> pa.Array:
        a, b = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), w.shape[1]) for v in (text, label))
        z = a @ w[0] + b @ w[1] + np.abs(a - b) @ w[2] + (a * b) @ w[3] + intercept
        return pa.array(1.0 / (1.0 + np.exp(-z)))

    return pairs.withColumn("score", prob(*(F.col(c).cast("array<double>") for c in (text_vec, label_vec))))


def pair_weights(model) -> tuple[list[float], float]:
    """Coefficients (over X14's features) and intercept of a fitted pair classifier."""
    return [float(c) for c in model.coefficients], float(model.intercept)


def best_entailed(queries: DataFrame, cands: DataFrame, weights: list[float], intercept: float, scope_col: str = "scope", key: str = "uid",
                  vec: str = "vec", lvec: str = "lvec", carry=(), block_bytes: int | None = None) -> DataFrame:
    """P2 + M2 + W6 in the row: the label that the linear pair model holds most likely entailed, and its probability.

    The model's sum over [a; b; |a-b|; a*b] falls into a text part (once per row), a label part (once per label, and
    carried with it) and a joint part.  With |b| counted in the label part, the joint part has terms only where the
    text's vector is not zero: w3 (|a-b| - |b|) + (w4 b) a.  So no pair is emitted: labels travel in blocks
    of bounded bytes, and each row keeps the best of its scope, ties (of probabilities at 9 digits) to the lowest label.

    A null vector counts as zero.  Returns ``(key, carry..., pred, score)``, one row per query row; without a candidate both are null.
    """
    d = len(weights) // 4
    if len(weights) != 4 * d:
        raise ValueError("weights must cover the four parts of a pair's features")
    w_text, w_label, w_gap, w_both = (weights[i * d:(i + 1) * d] for i in range(4))
    lit = lambda w: F.lit([float(x) for x in w])
    b = V.as_double(lvec)
    bias = V.dot(b, lit(w_label)) + V.dot(F.transform(b, F.abs), lit(w_gap)) + F.lit(intercept)
    labels = cands.select(scope_col, "label", b.alias("__b"), F.zip_with(b, lit(w_both), lambda x, w: x * w).alias("__wb"), bias.alias("__bias"))
    carry = [c for c in carry if c != key]
    q = queries.select(*dict.fromkeys([key, *carry, scope_col]), F.coalesce(V.as_double(vec), lit([0.0] * d)).alias("__a"))
    some = F.filter(F.transform("__a", lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(lit(w_gap), i).alias("w"))), lambda t: t["x"] != 0)

    def choose(arr):
        def of(text, terms):
            joint = lambda c: F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["w"] * (
                F.abs(t["x"] - F.get(c["__b"], t["i"])) - F.abs(F.get(c["__b"], t["i"]))) + t["x"] * F.get(c["__wb"], t["i"]))
            sure = lambda c: F.round(1.0 / (1.0 + F.exp(-(text + c["__bias"] + joint(c)))), TIE_DIGITS)
            mine = F.filter(arr, lambda c: c[scope_col] == F.col(scope_col))
            return F.array_min(F.transform(mine, lambda c: F.struct((-sure(c)).alias("o"), c["label"].alias("label"))))
        return V.let(V.dot("__a", lit(w_text)), lambda text: V.let(some, lambda terms: of(text, terms)))

    out = best_candidate(q, candidate_blocks(labels, labels.columns, block_bytes, scope_col), choose, by=scope_col)
    return out.select(key, *carry, F.col("__best.label").alias("pred"), (-F.col("__best.o")).alias("score"))
