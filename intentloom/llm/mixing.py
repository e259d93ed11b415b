"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: every source gets its weight's share of ``share`` times all tokens, but at most
   ``most`` times its own; what is cut is shared anew by weight (water filling: one level
   ``c`` with target = min(cap, c * weight)).
2. Blocks of ``block`` tokens go to the sources by highest quotients target / (2j + 1), which
   gives whole numbers of blocks; each source's blocks go to its shards the same way, by size.
3. A shard lays its documents in seeded order and cuts the stream into blocks.  Its quota takes
   all blocks as often as it can, and the rest as a cyclic run that starts at a seeded block, so
   at most three documents of a shard are cut.

Plan: one narrow shuffle of (doc_id, size, source); shards hold about ten times the square root of
all tokens, so a source with a third of all rows has many, and a window only ever sees one
shard.  Source and shard tables are narrow; quotients are ranked only between two bounds
within which the last seats must lie (at most two per seat-holder).

Defined results: null text has no tokens, a null source is a source of its own (last); sources
without tokens have target 0; rows repeated whole are separate documents; an empty table gives
no rows; extra columns play no part; reruns agree (hashes, no random numbers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intentloom.llm.common import stored, with_text

WORD = r"[^\x20\x09-\x0D]+"


def words(col="text"):
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``source, source_size`` -> adds ``target``; weights repeat along the sources in code-point order, null last."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in weights))
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumns({"cap": F.col("source_size") * F.lit(most), "fill": F.col("source_size") * F.lit(most) / F.col("weight"),
                       "all": F.sum("source_size").over(W.partitionBy()) * F.lit(share)})
    by_fill = W.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", level)
    # it rises along the order until a source's cap is above it, and falls from there on
    s = s.withColumn("level", F.max("level").over(W.partitionBy()))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Seats of each group to its parties by highest quotients weight / (2j + 1), ties by ``party``.

    With n parties and W the sum of weights, the last quotient taken lies between W / (N + n/2) and
    W / (N - n/2): only quotients between the two are ranked, about one per party.
    """
    g = W.partitionBy(*group)
    n, total, asked = F.count("*").over(g), F.sum(weight).over(g), F.col(seats)
    p = parties.withColumns({"_n": n, "_w": total.cast("double")})
    fixed = F.when((asked > F.col("_n")) & (F.col("_w") > 0),
                   F.floor(F.col(weight) * (asked - F.col("_n") / 2) / F.col("_w") + 0.5 - 1e-9)).otherwise(0)
    upper = F.when(F.col("_w") > 0, F.ceil(F.col(weight) * (asked + F.col("_n") / 2) / F.col("_w") + 0.5)).otherwise(0)
    p = p.withColumns({"_low": F.greatest(fixed, F.lit(0)).cast("long"), "_top": F.greatest(upper, F.lit(0)).cast("long")})
    p = p.withColumn("_open", asked - F.sum("_low").over(g))
    tries = (p.filter("_top > _low").withColumn("_seat", F.explode(F.expr("sequence(_low + 1, _top)")))
             .withColumn("_q", F.col(weight) / (2 * F.col("_seat") - 1)).filter("_q > 0"))
    order = W.partitionBy(*group).orderBy(F.desc("_q"), *(F.col(c).asc_nulls_last() for c in party), "_seat")
    won = (tries.withColumn("_r", F.row_number().over(order)).filter("_r <= _open")
           .groupBy(*group, *party).agg(F.count("*").alias("_more")))
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*group, *party]]
    joined = p.alias("p").join(won.alias("m"), keys, "left")
    return joined.select(*(F.col(f"p.{c}").alias(c) for c in parties.columns), (F.col("p._low") + F.coalesce("m._more", F.lit(0))).alias(out))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 16, seed: int = 11) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, text, source)``.

    doc_id, source, size, source_size, target, taken, and how: ``passes`` whole passes and the word ranges
    ``[from1, to1)``, ``[from2, to2)`` once more; ``th`` tells rows that repeat a doc_id apart.
    """
    rows = stored(docs.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("th")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, list(weights), share, most)
    everything = W.partitionBy()
    sources = sources.withColumns({
        "seats": F.round(F.sum("target").over(everything) / block).cast("long"),
        "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / (10 * F.sqrt(F.sum("source_size").over(everything)) + 1))).cast("long"),
        "_all": F.lit(0)})
    sources = stored(sainte_lague(sources, ["_all"], ["source"], "target", "seats", "quota"), "mix-sources")
    chance = lambda *c: F.md5(F.concat_ws("|", F.lit(str(seed)), *c))
    number = lambda h: F.conv(F.substring(h, 1, 12), 16, 10).cast("long")
    placed = (rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
              .select("r.doc_id", "r.source", "r.size", "r.th", "s.source_size", "s.target", "s.shards", "s.quota")
              .withColumn("h", chance(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
              .withColumn("shard", F.pmod(number("h"), F.col("shards"))))
    shard = (placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("source_quota")))
    quota = stored(sainte_lague(shard, ["source"], ["shard"], "shard_size", "source_quota", "shard_quota")
                   .withColumn("blocks", F.ceil(F.col("shard_size") / block).cast("long"))
                   .withColumn("shard_quota", F.least("shard_quota", (F.col("blocks") * F.lit(most)).cast("long")))
                   .withColumn("begin", F.when(F.col("blocks") > 0, F.pmod(number(chance(
                       F.lit("run"), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), F.col("blocks"))).otherwise(0)), "mix-quotas")
    stream = W.partitionBy("source", "shard").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", "th")
    laid = placed.withColumn("start", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    d = (laid.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
         .select("d.doc_id", "d.source", "d.size", "d.th", "d.source_size", "d.target", "d.start", "q.shard_size", "q.shard_quota", "q.blocks", "q.begin"))
    rest = F.when(F.col("blocks") > 0, F.col("shard_quota") % F.col("blocks")).otherwise(0)
    d = d.withColumns({"passes": F.when(F.col("blocks") > 0, F.floor(F.col("shard_quota") / F.col("blocks"))).otherwise(0).cast("long"), "rest": rest})
    ends = F.col("start") + F.col("size")
    within = lambda x: F.least(F.greatest(x, F.col("start")), ends) - F.col("start")  # noqa: E731  # a stream place as a word of the document
    d = d.withColumns({"from1": within(F.col("begin") * block), "to1": within((F.col("begin") + F.col("rest")) * block),
                       "from2": within(F.lit(0)), "to2": within(F.greatest(F.col("begin") + F.col("rest") - F.col("blocks"), F.lit(0)) * block)})
    return d.withColumn("taken", F.col("passes") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "passes", "from1", "to1", "from2", "to2", "th")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the text that the mix takes, in all of its columns: documents that give nothing go, others
    hold their words as often as they are taken (whole passes keep the text as it is)."""
    took = mix(docs.select("doc_id", "text", "source"), **options).filter("taken > 0").dropDuplicates(["doc_id", "th"])
    took = took.select(F.col("doc_id").alias("took_id"), F.col("th").alias("took_th"), "size", "passes", "from1", "to1", "from2", "to2")
    # the input's columns travel in one struct, so that no name of theirs meets one of these
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.struct(*(f"`{c}`" for c in docs.columns if c != "text")).alias("row"))
    ws = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    piece = lambda a, b: F.when(F.col(b) > F.col(a), F.when(F.col(b) - F.col(a) == F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(ws, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")), " ")))
    whole = F.when(F.col("passes") > 0, F.array_join(F.array_repeat("text", F.col("passes").cast("int")), "\n"))
    joined = rows.join(took, F.col("doc_id").eqNullSafe(F.col("took_id")) & (F.col("th") == F.col("took_th")))
    new = joined.select("row", F.concat_ws("\n", whole, piece("from2", "to2"), piece("from1", "to1")).alias("text"))
    return new.select(*with_text(docs, F.col("text")))
