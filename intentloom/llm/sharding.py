"""Sharding by Hilbert-curve order: quantise several metadata dimensions, sort by curve index, cut runs.

Dimensions are quantised at approximate quantiles (so each cell row holds about as many
documents, however skewed the values), the cells are numbered along the Hilbert curve, and
the sorted documents are cut into shards of equal row counts (law ``rows``: at most one
apart).  Neighbours on the curve are near in every dimension, so a shard's min/max of each
dimension is narrow and files can be skipped by any of them.  Copies of a text take the
place of their earliest document and so lie side by side; a group is only divided where a
cut falls into it.  Strings are placed by the rank of their whole value among the different values.

Plan: texts are read once for size and checksums; all else moves narrow rows.  The order is a
range partitioning on (index, text hash, doc_id), so a cell or text that holds a third of all
rows is still divided, no join gathers the rows of one text or source, and a row's global rank is its place in its partition plus the sizes
of the partitions before it (one row per partition).

Defined results: a null text has size 16 and checksum 0 and is not equal to an empty text's
group only by its null; null dimensions lie lowest; rows repeated whole each get a slot; an
empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intentloom.llm.common import doc_key, lookup, shuffle_partitions, stored

_ROW_BITS = 33  # of monotonically_increasing_id


def text_rank(rows: DataFrame, name: str, out: str, total: int) -> DataFrame:
    """``rows`` (a written table) with ``out``: the place of the string ``name`` among the different values in code-point
    order, as a double (null: null).  Whole values count, however much of their beginnings they share."""
    values = stored(rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")), "values")
    places = stored(ranked(values, [name], out).select(name, "n", F.col(out).cast("double").alias(out)), "places")
    return lookup(rows, places, name, total).drop("n")


def quantise(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Replace each numeric dimension by its cell number, 0 to 2**bits - 1 (null: 0)."""
    cells = 1 << bits
    at = [i / cells for i in range(1, cells)]
    cuts = df.agg(*(F.percentile_approx(F.coalesce(F.col(d), F.lit(float("-inf"))), at, 1000).alias(d) for d in dims)).first()
    for d in dims:
        edges = Counter(cuts[d] or [float("inf")])  # a value that holds many rows spans many cells
        v = F.coalesce(F.col(d), F.lit(float("-inf")))
        df = df.withColumn(d, sum((F.when(v > F.lit(e), n).otherwise(0) for e, n in sorted(edges.items())), F.lit(0)).cast("int"))
    return df


def hilbert_index(df: DataFrame, dims: list[str], bits: int, out: str = "hilbert") -> DataFrame:
    """Add the Hilbert curve's index of the cell ``dims`` (integers below 2**bits).

    Walks the bits from the top: each step mirrors or swaps axes so that the sub-cube's
    curve starts where the last one ended; then Gray-decodes and interleaves the bits.
    """
    x = [f"_axis{i}" for i in range(len(dims))]
    df = df.withColumns({a: F.col(d).cast("long") for a, d in zip(x, dims)})
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i, a in enumerate(x):
            first, own = F.col(x[0]), F.col(a)
            flip = own.bitwiseAND(F.lit(1 << b)) != 0
            swap = first.bitwiseXOR(own).bitwiseAND(F.lit(low))
            new = {x[0]: F.when(flip, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))}
            if i:
                new[a] = F.when(flip, own).otherwise(own.bitwiseXOR(swap))
            df = df.withColumns(new)
    for i in range(1, len(x)):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_turn", turn)
    df = df.withColumns({a: F.col(a).bitwiseXOR(F.col("_turn")) for a in x})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(a), b).bitwiseAND(F.lit(1)))
    return df.withColumn(out, index).drop(*x, "_turn")


def ranked(df: DataFrame, keys: list[str], out: str = "rank") -> DataFrame:
    """Add the global 0-based rank in the order of ``keys``, and ``total``: no task sees more than its range."""
    n = shuffle_partitions(df.sparkSession)
    placed = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = W.orderBy("_part")  # one row per partition
    before = sizes.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("total"))
    before = stored(before, "ranked-offsets")
    return (placed.withColumn("_part", part).join(before, "_part")
            .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_at", "_part", "_before"))


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 4) -> DataFrame:
    """Every row of ``docs(doc_id, text, lang, source)`` in a shard: doc_id, size, text_crc32, hilbert, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    narrow = stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"),
                                F.xxhash64(text, F.col("text").isNull()).alias("th"), "lang", "source"), "shard-rows")
    total = narrow.count()
    # a text's place is that of its earliest document
    group = stored(narrow.groupBy("th").agg(F.min(F.struct(doc_key().alias("id"), "lang", "source")).alias("g"), F.count("*").alias("n")).filter("n > 1"), "shard-texts")
    own = F.coalesce("g", F.struct(doc_key().alias("id"), "lang", "source"))
    rows = lookup(narrow, group, "th", total).withColumn("g", own).select(
        "doc_id", "bytes", "text_crc32", "th", F.col("g.id").cast("double").alias("d_id"), F.col("g.lang").alias("lang"), F.col("g.source").alias("source"),
        F.col("bytes").cast("double").alias("d_size"))
    rows = text_rank(stored(rows, "shard-places"), "lang", "d_lang", total)
    rows = text_rank(stored(rows, "shard-places"), "source", "d_source", total).drop("lang", "source")
    rows = stored(rows, "shard-places")
    dims = ["d_lang", "d_source", "d_size", "d_id"]
    rows = hilbert_index(quantise(rows, dims, bits), dims, bits)
    s, n, r = F.lit(shards).cast("long"), F.col("total"), F.col("rank")
    return (ranked(rows.drop(*dims), ["hilbert", "th", "doc_id"])
            .withColumn("shard", F.expr(f"rank * {shards} div total").cast("int"))
            .select("doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32", "hilbert", F.lit("rows").alias("law"), "shard",
                    (r - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, shards: int = 40, bits: int = 4) -> DataFrame:
    """Write ``docs`` as Parquet below ``path``, one folder per shard and rows in curve order; returns each
    shard's bounds for pruning: shard, rows, and min/max of lang, source, size and doc_id."""
    placed = hilbert_shards(docs, shards, bits).select("doc_id", "shard", "slot", "size")
    (docs.join(placed, "doc_id").repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
    back = docs.sparkSession.read.parquet(path)
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size", "doc_id") for n, f in (("min", F.min), ("max", F.max))]
    return back.groupBy("shard").agg(F.count("*").alias("rows"), *bounds)
