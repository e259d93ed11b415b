"""Tokens, vocabularies, id sequences and token-vector pooling.

Token rows are long form ``(uid, pos, token)`` produced by ``posexplode``:
work spreads over all tasks whatever the text length.  Vector pooling first
counts ``(uid, word)`` so each distinct word of a text meets its vector once,
and pools with ML ``Summarizer`` (partial aggregation, one d-wide buffer per
text) instead of exploding vectors to one row per dimension.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from intentloom.functions import text as T
from intentloom.functions import vectors as V
from intentloom.functions.order import hash_int
from intentloom.operators.joins import checked_broadcast, hot_join
from intentloom.operators.rank import global_rank

PAD_ID = 0
UNKNOWN_ID = 1  # the reference maps unknown words to the id of its 'null' word


def tokens(df: DataFrame, text: str = "utterance", key: str = "uid", keep_empty: bool = True) -> DataFrame:
    """X2 long form: ``(key, pos, token)`` with blank tokenization (0-based pos).
    An empty or null text has one empty token, so its key stays."""
    t = df.select(key, F.posexplode(T.blank_tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "token"))
    return t if keep_empty else t.where(F.col("token") != "")


def max_len(*dfs: DataFrame, text: str = "utterance") -> DataFrame:
    """The longest blank-token count over several tables."""
    u = None
    for d in dfs:
        s = d.select(T.token_count(text).alias("n"))
        u = s if u is None else u.unionByName(s)
    return u.agg(F.max("n").cast("long").alias("max_len"))


def word_counts(toks: DataFrame, min_count: int = 1) -> DataFrame:
    """Token frequencies ``(word, n)`` (partial aggregate before the shuffle)."""
    return toks.where(F.col("token") != "").groupBy(F.col("token").alias("word")) \
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def vocab_ids(toks: DataFrame, min_count: int = 1, first_id: int = 2, nmax: int | None = None) -> DataFrame:
    """Vocabulary ``(word, n, word_id)`` ranked by frequency, then word.

    The full ranking is a distributed total order (``global_rank``), never a
    one-task window over the vocabulary.  With ``nmax`` (L4, the vocabulary
    cap) only the top ``nmax`` words are kept, by a distributed top-K
    (TakeOrderedAndProject), and numbered in that small result.
    """
    counts = word_counts(toks, min_count)
    order = [F.col("n").desc(), F.col("word")]
    if nmax is not None:
        top = counts.orderBy(*order).limit(nmax)
        from intentloom.operators.rank import small_rank
        r = small_rank(top, order, out="__r")  # nmax rows: bounded by the cap
    else:
        r = global_rank(counts, order, out="__r")
    return r.select("word", "n", (F.col("__r") + F.lit(first_id - 1)).cast("int").alias("word_id"))


def token_ids(toks: DataFrame, vocab: DataFrame, key: str = "uid", unknown_id: int = UNKNOWN_ID, max_bytes: int | None = None) -> DataFrame:
    """Id sequence per text, unknown words -> ``unknown_id``.

    The vocabulary is broadcast after a size check; above the bound only the entries of hot words are,
    and the others meet in a shuffle (``hot_join``).  Returns ``(key, ids ARRAY<INT>)``
    in token order.
    """
    j = hot_join(toks, vocab.select(F.col("word").alias("token"), "word_id"), "token", max_bytes=max_bytes).withColumn("id", F.coalesce(F.col("word_id"), F.lit(unknown_id)))
    g = j.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("__s"))
    return g.select(key, F.transform("__s", lambda s: s["id"].cast("int")).alias("ids"))


def hashed_token_ids(df: DataFrame, text: str = "utterance", key: str = "uid", vocab: int = 30000) -> DataFrame:
    """Ids without a vocabulary: ``HASH_ID_BASE + md5 bucket`` per blank token."""
    return df.select(key, T.hashed_ids(T.blank_tokens(text), vocab).alias("ids"))


def bow_tokens(text) -> "F.Column":
    """Lower-cased blank tokens without empties (hash-encoder input)."""
    return F.filter(F.split(T.strip(F.lower(text if not isinstance(text, str) else F.col(text))), " "),
                    lambda t: t != "")


SLICE_BYTES = 8 << 20  # of texts that a task splits at a time


def _bucket_counts(dim: int, names: list[str]):
    """For ``mapInArrow`` over ``(key, lower-cased text)``: ``(key, counts)``, how many words of the text fall into each md5
    bucket.  Texts are stripped as ``text.strip`` does; a slice of a batch hashes each of its different words once."""
    def run(batches):
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
            start = np.flatnonzero(np.diff(size // SLICE_BYTES, prepend=-1)).tolist()
            for i, j in zip(start, [*start[1:], b.num_rows]):
                words = pc.split_pattern(pc.ascii_trim_whitespace(b.column(1).slice(i, j - i)).cast(pa.binary()), b" ")
                flat = words.flatten().dictionary_encode()
                here = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
                heads = np.frombuffer(b"".join(hashlib.md5(w).digest()[:4] for w in here), ">u4").astype(np.int64)
                bucket = np.where([w != b"" for w in here], heads % dim, -1)[flat.indices.to_numpy()]
                row = pc.list_parent_indices(words).to_numpy().astype(np.int64)
                some = bucket >= 0
                counts = np.bincount(row[some] * dim + bucket[some], minlength=(j - i) * dim)
                ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names)
    return run


def hash_encode(df: DataFrame, dim: int = 64, text: str = "utterance", key: str = "uid",
                long_form: bool = False) -> DataFrame:
    """Hashed bag of words: ``vec[i]`` = count of tokens whose md5 bucket is i.

    Words are split and counted where the text is, in Arrow batches, so no word is shuffled: a text
    sends its ``dim`` counts, and those of texts that share a key are added.  A text
    without tokens (null, empty) has the zero vector, and no row in the long form.
    """
    col = F.col(text) if isinstance(text, str) else text
    schema = S.StructType([S.StructField(key, df.schema[key].dataType), S.StructField("__n", S.ArrayType(S.LongType()))])
    t = df.select(F.col(key), F.lower(col).alias("__t")).mapInArrow(_bucket_counts(dim, [key, "__n"]), schema)
    c = t.groupBy(key).agg(*[F.sum(F.get("__n", F.lit(i))).alias(f"__n{i}") for i in range(dim)])
    if long_form:
        return c.select(key, F.posexplode(F.array(*[f"__n{i}" for i in range(dim)])).alias("dim", "value")) \
            .where(F.col("value") > 0).select(key, F.col("dim").cast("long").alias("dim"), "value")
    return c.select(key, F.array(*[F.coalesce(F.col(f"__n{i}"), F.lit(0)).cast("double") for i in range(dim)]).alias("vec"))


def hashed_word_vectors(words: DataFrame, emb: DataFrame, word: str = "word") -> DataFrame:
    """A word-vector table for any words: each word takes the embedding row
    ``md5 bucket % count(emb)`` (stand-in for a pretrained table)."""
    n = emb.select(F.count(F.lit(1))).scalar()
    return words.select(word).distinct().withColumn("vec_id", hash_int(word) % n) \
        .join(emb.select("vec_id", F.col("embedding").alias("vec")), "vec_id").drop("vec_id")


def word_vectors(toks: DataFrame, wv: DataFrame, key: str = "uid", max_bytes: int | None = None) -> DataFrame:
    """Token -> vector (left join: unknown words get a NULL vector), at any size of the table (``hot_join``)."""
    return hot_join(toks, wv.select(F.col("word").alias("token"), "vec"), "token", max_bytes=max_bytes)


def _every_key(toks: DataFrame, pooled: DataFrame, key: str, texts: DataFrame | None = None) -> DataFrame:
    """``pooled`` for each key of ``texts`` (without: of ``toks``): a text without a known word keeps its row, with NULL vectors.
    From the texts only the keys are read, and no text is split again."""
    if texts is not None:
        return texts.select(key).join(pooled, key, "left")
    return toks.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).drop("__rows").join(pooled, key, "left")


def pool_max_mean(toks: DataFrame, wv: DataFrame, key: str = "uid", texts: DataFrame | None = None) -> DataFrame:
    """Per text, element-wise max and mean of its known token
    vectors, concatenated as ``[max; mean]``.

    Distinct (text, word) pairs are counted first, so each word's vector is
    joined once per text; the mean is weighted by the counts.
    """
    c = toks.where(F.col("token") != "").groupBy(key, "token").agg(F.count(F.lit(1)).alias("__n"))
    v = checked_broadcast(wv.select(F.col("word").alias("token"), array_to_vector(V.as_double("vec")).alias("__v")))
    j = c.join(v, "token")
    s = j.groupBy(key).agg(
        Summarizer.max(F.col("__v")).alias("__max"),
        Summarizer.mean(F.col("__v"), F.col("__n").cast("double")).alias("__mean"))
    return _every_key(toks, s.select(key, vector_to_array("__max").alias("max_pool"), vector_to_array("__mean").alias("mean_pool"),
                                     F.concat(vector_to_array("__max"), vector_to_array("__mean")).alias("pooled")), key, texts)


def idf_weights(toks: DataFrame, key: str = "uid", texts: DataFrame | None = None) -> DataFrame:
    """Inverse document frequency per word: ``ln(N / df)`` (a weight table for X15).  N is the number
    of rows of ``texts``; without it, the distinct keys of the tokens are counted."""
    n = (toks.select(F.countDistinct(key)) if texts is None else texts.select(F.count(F.lit(1)))).scalar()
    dfc = toks.where(F.col("token") != "").select(key, "token").distinct().groupBy("token") \
        .agg(F.count(F.lit(1)).alias("df"))
    return dfc.select(F.col("token").alias("word"), F.log(n.cast("double") / F.col("df").cast("double")).alias("w"))


def weighted_pool(toks: DataFrame, wv: DataFrame, weights: DataFrame, key: str = "uid") -> DataFrame:
    """Softmax over a text's known tokens of their weights, then the
    weighted sum of token vectors (``sum(a_i * v_i)``)."""
    w = checked_broadcast(weights.select(F.col("word").alias("token"), "w"))
    v = checked_broadcast(wv.select(F.col("word").alias("token"), "vec"))
    j = toks.where(F.col("token") != "").join(v, "token").join(w, "token")
    win = Window.partitionBy(key)
    j = j.withColumn("__e", F.exp(F.col("w") - F.max("w").over(win)))
    j = j.withColumn("__a", F.col("__e") / F.sum("__e").over(win))
    j = j.select(key, array_to_vector(V.vscale("vec", F.col("__a"))).alias("__wv"))
    g = j.groupBy(key).agg(Summarizer.sum(F.col("__wv")).alias("__s")).select(key, vector_to_array("__s").alias("pooled"))
    return _every_key(toks, g, key)


def piecewise_pool(toks: DataFrame, wv: DataFrame, key: str = "uid", pieces: int = 3) -> DataFrame:
    """Split each text's tokens into ``pieces`` position segments
    (``segment = (pieces * pos) div len``), max-pool vectors per segment, and
    concatenate the segments in order (missing segments are zeros)."""
    n = toks.groupBy(key).agg(F.count(F.lit(1)).alias("__len"))
    v = checked_broadcast(wv.select(F.col("word").alias("token"), array_to_vector(V.as_double("vec")).alias("__v")))
    j = toks.join(n, key).join(v, "token")
    j = j.withColumn("segment", F.floor((F.col("pos") * pieces).cast("double") / F.col("__len")).cast("int"))
    s = j.groupBy(key, "segment").agg(Summarizer.max(F.col("__v")).alias("__m")) \
        .select(key, "segment", vector_to_array("__m").alias("m"))
    g = s.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("segment", "m"))).alias("__segs"),
                           F.max(F.size("m")).alias("__d"))
    zero = F.array_repeat(F.lit(0.0), F.col("__d"))
    parts = [F.coalesce(F.element_at("__segs", F.lit(i)), zero) for i in range(pieces)]
    return _every_key(toks, g.select(key, F.concat(*parts).alias("pooled")), key)


def length_buckets(df: DataFrame, text: str = "utterance") -> DataFrame:
    """L3: power-of-two length buckets (``ceil(log2(len))``) and rows sorted by
    length, longest first, inside each partition (packing for a batch encoder)."""
    x = df.withColumn("len", T.token_count(text).cast("long"))
    x = x.withColumn("bucket", F.ceil(F.log2(F.greatest(F.col("len"), F.lit(1)).cast("double"))).cast("int"))
    return x.sortWithinPartitions(F.col("len").desc())


def length_order(df: DataFrame, text: str = "utterance", key: str = "uid") -> DataFrame:
    """L3: ``len`` and ``sorted_pos``, the place of each row by length, longest first (a distributed total order)."""
    return global_rank(df.withColumn("len", T.token_count(text).cast("long")), [F.col("len").desc(), F.col(key)], out="sorted_pos")


def restore_order(rows: DataFrame, key: str = "uid") -> DataFrame:
    """L3: the rows of ``length_order`` (or what an encoder made of them) numbered in their first order again, as ``pos``."""
    return global_rank(rows, [F.col(key)], out="pos")


def summarize_vec(col: str, digits: int = 6):
    """(sum, L2 norm) of a vector column, rounded: compact value checks."""
    return [F.round(V.vsum(col), digits).alias(f"{col}_sum"), F.round(V.norm(col), digits).alias(f"{col}_norm")]
