"""Document fingerprints: bottom-k sketches of word-shingle hashes.

The sketch of a set is its ``k`` least hashes.  The sketch of a union is the ``k`` least of the two
sketches' hashes, so sketches of parts merge in any order.  From two sketches: resemblance (the
share of the union sketch that is in both), containment, and the number of distinct shingles.
Sets of fewer than ``k`` shingles are held whole, and their figures are exact.

All of it is column expressions.  Words are runs of non-space characters; a text of fewer words
than a shingle has one shingle, all its words; a null or empty text has the empty sketch; two empty
sketches have likeness 1.

``with_next`` gives each document the next one (descending id, null first; after the last the first):
ids (and, for an id with very many rows, hashes of the texts) are cut into blocks at approximate quantiles, one shuffle brings each block's texts together, a
window looks one row ahead, and only each block's last row gets its neighbour from a table with one
row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intentloom.llm.common import MAX_LONG, doc_key, shuffle_partitions, stored

SHINGLE, K, HASH_BITS = 5, 128, 48


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """The ``k`` least distinct shingle hashes, ascending."""
    cut = 64 - HASH_BITS

    def of(ws):
        many = F.transform(F.sequence(F.lit(0), F.size(ws) - F.lit(width)), lambda i: F.shiftrightunsigned(
            F.xxhash64(*(F.get(ws, i + F.lit(j)) for j in range(width))), cut))
        return F.when(F.size(ws) >= width, F.slice(F.sort_array(F.array_distinct(many)), 1, k)) \
            .when(F.size(ws) > 0, F.array(F.shiftrightunsigned(F.xxhash64(ws), cut))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), ""), of)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sketched sets (exact below ``k`` shingles)."""
    return _let(merge(a, b, k), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second."""
    union = merge(a, b, k)
    mine = F.array_intersect(union, a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(mine) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(mine, b)) / F.size(mine))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * 2.0 ** HASH_BITS) / F.element_at(a, -1))


def merge_groups(df: DataFrame, key: str, col: str, k: int = K) -> DataFrame:
    """One sketch per key over all its rows; a hot key ships ``k`` hashes per task."""
    each = df.select(key, F.explode(col).alias("h")).distinct()
    least = each.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("h"))).filter(F.col("n") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(col))


def as_text(a: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits per hash, ascending."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def _blocks(keys: DataFrame, n: int):
    """A column expression's steps that number ``(_key, _th)`` by ``n`` (a power of two) blocks, in their order: cut at
    quantiles of the key, and a key that holds several quantiles (such as null) is dealt to as many blocks by its hash."""
    at = [i / n for i in range(1, n)]
    cuts = keys.agg(F.percentile_approx("_key", at, max(10_000, 4 * n)).alias("c")).first()["c"] or []
    cuts = sorted(cuts) + [MAX_LONG] * (n - 1 - len(cuts))
    edges = F.array(*(F.lit(int(c)) for c in cuts))

    def below(df: DataFrame, out: str, strict: bool) -> DataFrame:
        """Adds the number of edges below the key (or up to it): binary search."""
        df, step = df.withColumn(out, F.lit(0)), n // 2
        while step:
            b, edge = F.col(out), F.element_at(edges, F.col(out) + step)
            df = df.withColumn(out, F.when((edge < F.col("_key")) if strict else (edge <= F.col("_key")), b + step).otherwise(b))
            step //= 2
        return df

    def put(df: DataFrame) -> DataFrame:
        df = below(below(df, "_block", True), "_upto", False)
        spread = F.greatest(F.col("_upto") - F.col("_block"), F.lit(1))
        share = F.col("_th") / F.lit(2.0 ** 64) + 0.5  # rises with the hash, from 0 to 1
        return df.withColumn("_block", F.col("_block") + F.least(F.floor(share * spread), spread - 1).cast("int")).drop("_upto")
    return put


def with_next(docs: DataFrame, of_next: dict) -> DataFrame:
    """``docs(doc_id, text)`` with ``next_text`` and, for each ``name: function`` of ``of_next``, ``name`` (the
    function of the row's text) and ``next_name`` (that of the next row's)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", doc_key().alias("_key"), F.xxhash64(text).alias("_th"), text.alias("text"))
    narrow = stored(keyed.select("_key", "_th"), "next-keys")
    n = 1 << max(1, (2 * shuffle_partitions(spark) - 1).bit_length())
    put = _blocks(narrow, n)
    # each block's first row, and the text that follows its last one: one row per block
    heads = put(narrow).groupBy("_block").agg(F.max(F.struct("_key", "_th")).alias("h")).select("_block", "h._key", "h._th")
    texts = (keyed.join(heads, ["_key", "_th"]).dropDuplicates(["_block"])
             .select("_block", F.col("text").alias("_head"), *(f(F.col("text")).alias(f"_head_{name}") for name, f in of_next.items())))
    texts = stored(texts, "next-heads")
    lower = W.orderBy("_block")
    back = W.orderBy(F.desc("_block"))
    follow = texts.select("_block", *(F.coalesce(F.lag(c).over(lower), F.first(c).over(back)).alias(c) for c in texts.columns[1:]))
    w = W.partitionBy("_block").orderBy(F.desc("_key"), F.desc("_th"))
    rows = put(keyed).withColumn("next_text", F.lead("text").over(w))
    rows = rows.withColumns({name: f(F.col("text")) for name, f in of_next.items()})
    rows = rows.withColumns({f"next_{name}": F.lead(name).over(w) for name in of_next})
    joined = rows.join(follow, "_block", "left")
    last = F.col("next_text").isNull()
    out = {f"next_{name}": F.when(last, F.col(f"_head_{name}")).otherwise(F.col(f"next_{name}")) for name in of_next}
    return joined.select("doc_id", "text", F.coalesce("next_text", "_head").alias("next_text"), *of_next, *(c.alias(k) for k, c in out.items()))


def edited(text: Column, following: Column) -> Column:
    """The last half of ``text`` (floor) replaced by as much of the beginning of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """Each document's sketch, its edited text's, and their likeness; see the queries for the columns."""
    rows = with_next(docs, {"sk": lambda t: sketch(t, k, width)})
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "sk", "next_sk", sketch(F.col("edited"), k, width).alias("edited_sk"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sk")).alias("fingerprint"), as_text(F.col("edited_sk")).alias("edited_fingerprint"),
                       resemblance(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"),
                       resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
                       distinct_shingles(F.col("sk"), k).alias("distinct_shingles"))
