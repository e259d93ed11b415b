"""Join helpers with an explicit size check, in bytes, behind everything that is broadcast.

A table is written once to the shared folder, measured there, and only then broadcast or packed
into arrays.  Candidate tables (labels, prototypes, label vectors) travel as blocks of bounded
bytes: one block in practice, several passes over the rows above the bound, with the same rows
and results either way.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.session import materialize, shared_dir

MAX_BROADCAST_BYTES = 128 << 20
BLOCK_BYTES = 32 << 20  # of candidates that a task holds at a time
ROW_BYTES = 32  # per row, besides its values


def row_bytes(df: DataFrame) -> Column:
    """An estimate of each row's size in memory, from its values."""
    total = F.lit(ROW_BYTES).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            n = F.octet_length(c) + 16
        elif isinstance(f.dataType, VectorUDT):
            n = F.size(vector_to_array(c)) * 8 + 32
        elif isinstance(f.dataType, T.ArrayType):
            text = isinstance(f.dataType.elementType, (T.StringType, T.BinaryType))
            n = F.octet_length(F.concat_ws("", c.cast("array<string>"))) + F.size(c) * 16 if text else F.size(c) * 8 + 32
        else:
            n = F.lit(8)
        total = total + F.coalesce(n, F.lit(8))
    return total


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def checked_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` where its measured size is within ``max_bytes``.

    The table is written once to the shared folder, so measuring and joining read the same rows and
    nothing stays cached.  Above the bound Spark plans a shuffle join, with AQE splitting skewed
    partitions.
    """
    return broadcast_written(materialize(df), max_bytes)


def broadcast_written(t: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``checked_broadcast`` of a table that is written already (or a few columns of one): measured, not written again."""
    return F.broadcast(t) if table_bytes(t) <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes) else t


HOT_SHARE = 1000  # a key with more than one in so many rows is hot: there are at most that many


def hot_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left", max_bytes: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``, at any size of the table and any skew of the rows.

    Within the broadcast bound the table is broadcast.  Above it, the hot keys of the rows are found with a mergeable sketch of
    frequent items (one pass with partial sketches; a sketch's estimates only decide how a key travels): their
    entries, at most ``HOT_SHARE``, are broadcast, so hot rows stay where they are, and all other rows meet the table in a
    shuffle join in which no key is large.  Rows without a key match nothing and are not shuffled either."""
    if how not in ("left", "inner"):
        raise ValueError("left or inner")
    t = materialize(table)
    if table_bytes(t) <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes):
        return rows.join(F.broadcast(t), key, how)
    rows = materialize(rows)
    some = rows.where(F.col(key).isNotNull())
    sketch = some.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {HOT_SHARE}, {8 * HOT_SHARE})").alias("top"))
    hot = materialize(sketch.select("n", F.explode("top").alias("x")).where(F.col("x.count") * HOT_SHARE > F.col("n")).select(F.col("x.item").alias(key)))
    often = F.broadcast(hot)  # HOT_SHARE rows at most
    near = some.join(F.broadcast(t.join(often, key, "left_semi")), key, "inner")
    if how == "left":  # hot keys that the table lacks
        near = near.unionByName(some.join(often.join(t.select(key), key, "left_anti").hint("broadcast"), key, "left_semi"), allowMissingColumns=True)
    far = some.join(often, key, "left_anti").join(t, key, how)
    out = near.unionByName(far)
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def sized_broadcast(df: DataFrame, n_rows: int, max_rows: int = 200_000) -> DataFrame:
    """Broadcast narrow rows when a bound on their number known without running them (e.g. labels x
    buckets, from an earlier count) is within ``max_rows``."""
    return F.broadcast(df) if n_rows <= max_rows else df


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Write a small table once and count it: ``(table, rows)``."""
    t = materialize(df)
    return t, t.count()


def candidate_blocks(df: DataFrame, cols: list[str], block_bytes: int | None = None, by: str | None = None) -> list[DataFrame]:
    """``df`` as tables of about ``block_bytes`` each with a column ``__arr``, an ``ARRAY<STRUCT<cols>>``.

    A table has one row; where ``by`` (a scope) is given and takes several values, it has one row ``(by, __arr)``
    per value, so that a row meets the candidates of its own scope only.  Rows are dealt to blocks by a hash of
    their values, so a scope that holds most candidates is split like any other."""
    t = materialize(df.select(*cols))
    n = max(1, math.ceil(table_bytes(t) / (block_bytes or BLOCK_BYTES)))
    keys = [by] if by and t.select(by).distinct().limit(2).count() > 1 else []
    block = F.pmod(F.xxhash64(*cols), F.lit(n))
    return [(t if n == 1 else t.where(block == i)).groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("__arr")) for i in range(n)]


def with_block(rows: DataFrame, block: DataFrame, by: str | None = None) -> DataFrame:
    """``rows`` with ``__cands``, the block's candidates (of the row's own scope): bounded bytes, so a broadcast."""
    if len(block.columns) == 1:
        return rows.withColumn("__cands", block.scalar())
    return rows.join(F.broadcast(block.withColumnRenamed("__arr", "__cands")), by, "left")


def best_candidate(rows: DataFrame, blocks: list[DataFrame], choose, out: str = "__best", by: str | None = None) -> DataFrame:
    """``rows`` with ``out``: the least of the structs that ``choose(candidates)`` finds in each block (null: none).

    Every row is judged in place: none is lost, repeated or merged, and no query row is
    shuffled.  Between blocks the rows are written, so a plan holds one block."""
    for i, block in enumerate(blocks):
        if i:
            rows = materialize(rows)
        found = choose(F.col("__cands"))
        rows = with_block(rows, block, by).withColumn(out, F.least(F.col(out), found) if i else found).drop("__cands")
    return rows


def each_candidate(rows: DataFrame, blocks: list[DataFrame], mine, select, by: str | None = None) -> DataFrame:
    """One row per row and candidate in ``mine(candidates)``, as ``select(table with the candidate __c)`` gives it
    (a generator, not a join).  With several blocks, each one's pairs are written to the shared folder."""
    if len(blocks) > 1:
        rows = materialize(rows)
    parts = [select(with_block(rows, b, by).withColumn("__c", F.explode(mine(F.col("__cands")))).drop("__cands")) for b in blocks]
    if len(parts) == 1:
        return parts[0]
    path = shared_dir(rows.sparkSession, "pairs")
    for i, p in enumerate(parts):
        p.write.parquet(f"{path}/block={i}")
    return rows.sparkSession.read.schema(parts[0].schema).parquet(*[f"{path}/block={i}" for i in range(len(parts))])
