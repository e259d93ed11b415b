"""Helpers shared by the training-data operators: tables, shared storage, byte views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentloom.session import shared_dir

MAX_LONG = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage in a folder that every executor sees, keeps column pruning for
    the readers, and survives lost executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame, text) -> list:
    """The columns of ``docs`` from a struct ``row`` of the others than ``text``, with a new text and its length in ``n_chars``."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key(doc_id="doc_id"):
    """Long order key of a document id; a null id sorts after every other id."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(MAX_LONG))


_HOT_KEYS = 10_000


def lookup(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``found(key, n, ...)``, which has one row per key and counts the rows of the key in ``n``.

    Keys that hold more than one in ``_HOT_KEYS`` of the ``total`` rows, so at most that many, are broadcast and their rows stay
    where they are; all others meet in a shuffle, in which no key is large.  Both are written tables, read twice."""
    hot = F.col("n") > max(total // _HOT_KEYS, 1)
    often = F.broadcast(found.filter(hot))
    some = rows.filter(F.col(key).isNotNull())
    return (some.join(often, key).unionByName(some.join(often.select(key), key, "left_anti").join(found.filter(~hot), key, "left"))
            .unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True))


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of a string or binary Arrow column (nulls as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def whole_groups(batches, keys: list[str], rows: int = 1 << 16):
    """Record batches sorted by ``keys`` -> tables of about ``rows`` rows that hold whole groups."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        open_ = None  # the rows of the last group, which may go on
        for k in keys:
            same = pc.equal(t.column(k), t.column(k)[-1])
            open_ = same if open_ is None else pc.and_(open_, same)
        cut = pc.index(open_, True).as_py()
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E6C63D0876A9A47)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class PrefixHash:
    """Polynomial hash (mod 2^64, random byte table) of any range of a byte buffer,
    from one prefix sum: ``range_hash(i, j)`` does not depend on where the range lies."""

    _BASE = 0x5851F42D4C957F2B
    _table = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    _pow = _inv = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int):
        if len(cls._pow) < n:
            n = max(n, 1 << 20)
            a = np.full(n, cls._BASE, np.uint64)
            b = np.full(n, pow(cls._BASE, -1, 1 << 64), np.uint64)
            a[0] = b[0] = 1
            cls._pow, cls._inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return cls._pow, cls._inv

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self.inv = self._powers(n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(self._table[data] * p[:n], out=self.sum[1:])

    def range_hash(self, i, j):
        return (self.sum[j] - self.sum[i]) * self.inv[i]

    def every(self, k: int) -> np.ndarray:
        """Hashes of all ranges of ``k`` bytes."""
        n = len(self.sum) - k
        return (self.sum[k:] - self.sum[:n]) * self.inv[:n] if n > 0 else np.zeros(0, np.uint64)
