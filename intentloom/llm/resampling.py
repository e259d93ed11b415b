"""Importance resampling towards a target corpus, over hashed n-grams found by overlapped regex scans.

* *Scan.*  A text's bytes are lower-cased (A-Z only) and every run of separators (ASCII bytes that are no digit
  or letter) becomes one space.  For each n, ``regex.finditer(overlapped=True)`` with lookarounds at word
  boundaries then matches n words joined by single spaces: each match span is an n-gram as it stands, and
  its crc32 modulo ``buckets`` is its bucket.  A document is stored once, as the buckets of its n-grams.
* *Counts.*  Every task adds up its own buckets, so at most ``buckets`` rows leave it, however often a word
  occurs.  The gains (one per bucket, a bound set by the parameter) are the log ratio of smoothed shares.
* *Draw.*  A document's weight is its mean gain; its score adds Gumbel noise from a hash of its id, so the
  highest scores are a draw without replacement in proportion to exp(weight).  Ranks come from the counts
  per score (scores are integers in thousandths of a nat, a bounded range) and an order within each score.

Defined results: a null text has no words, weight 0 and, like every text of fewer than ``least_words`` words, no rank; a
null id draws its noise from the empty name and ties after other ids; repeated rows are counted, scored and
ranked each; equal scores rank by id, then by a hash of the text; empty tables give no rows, and an empty target only
smoothed shares; extra columns play no part; whole texts of any length are scanned.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intentloom.llm.common import bytes_of, doc_key, stored
from intentloom.operators.joins import checked_broadcast

_EMIT = 16 << 20  # bytes of bucket numbers per emitted batch
_PART = 1 << 20  # n-grams whose gains are looked up at a time


def _folding() -> bytes:
    """A byte table: A-Z to lower case, every ASCII byte that is no digit or letter to a space."""
    table = bytearray(range(256))
    for b in range(128):
        table[b] = ord(chr(b).lower()) if chr(b).isalnum() else 32
    return bytes(table)


def collapsed(text: bytes) -> bytes:
    """The words of a UTF-8 text, lower-cased and joined by single spaces."""
    return b" ".join(text.translate(_folding()).split())


def _patterns(low: int, high: int):
    import regex
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(low, high + 1)]


def _scan(low: int, high: int, buckets: int):
    """Texts -> number of words, of n-grams, and each n-gram's bucket (packed unsigned integers)."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        patterns = _patterns(low, high)
        for b in batches:
            data, off = bytes_of(b.column("text"))
            raw, first, held, size = memoryview(data), 0, [], 0
            for i in range(b.num_rows):
                words = collapsed(bytes(raw[off[i]:off[i + 1]]))
                found = [np.fromiter((zlib.crc32(m[0]) % buckets for m in p.finditer(words, overlapped=True)), kind) for p in patterns]
                held.append((words.count(b" ") + 1 if words else 0, np.concatenate(found)))
                size += held[-1][1].nbytes
                if i + 1 < b.num_rows and size < _EMIT:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, len(held)), b.column("th").slice(first, len(held)), pa.array([n for n, _ in held], pa.int64()),
                     pa.array([len(x) for _, x in held], pa.int64()), pa.array([x.tobytes() for _, x in held], pa.binary())],
                    names=["doc_id", "th", "n_words", "n_features", "ids"])
                first, held, size = i + 1, [], 0
    return run


def scan(docs: DataFrame, low: int = 1, high: int = 2, buckets: int = 10_000) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, th (hash of the text), n_words, n_features, ids (packed buckets)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return keyed.mapInArrow(_scan(low, high, buckets), "doc_id long, th long, n_words long, n_features long, ids binary")


def _add_up(buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            data, _ = bytes_of(b.column("ids"))
            total += np.bincount(np.frombuffer(data.tobytes(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
    return run


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences per bucket over all rows (``buckets`` numbers, whatever the input)."""
    total = np.zeros(buckets, np.int64)
    for r in scanned.select("ids").mapInArrow(_add_up(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, floor(1000 ln) of the target's smoothed share over the source's."""
    big_s, big_t, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + k) / ((s + 1) * (big_t + k)))) for s, t in zip(source.astype(float), target.astype(float))], np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256(``seed:doc_id``)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, seed: int):
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches):
        for b in batches:
            data, off = bytes_of(b.column("ids"))
            ids, at = np.frombuffer(data.tobytes(), kind), off // kind().itemsize
            weight = [sum(int(gain[ids[k:min(k + _PART, j)]].sum()) for k in range(i, j, _PART)) // (j - i) if j > i else 0 for i, j in zip(at.tolist(), at[1:].tolist())]
            score = [w + noise(d, seed) for w, d in zip(weight, b.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "th", "n_words", "n_features")), pa.array(weight, pa.int64()), pa.array(score, pa.int64())],
                                             names=["doc_id", "th", "n_words", "n_features", "weight", "score"])
    return run


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... by falling score among the highest ``percent`` of the rows with enough words.

    Rows alike in all columns are ranked as one row with a count and told apart again at the end."""
    row = ["doc_id", "th", "n_words", "n_features", "weight", "score"]
    each = stored(scored.groupBy(*row).agg(F.count("*").alias("copies")), "scored")
    able = each.filter(F.col("n_words") >= least_words)
    down = W.orderBy(F.desc("score"))  # over the counts per score: an integer of bounded range
    per = able.groupBy("score").agg(F.sum("copies").alias("n"))
    per = per.select("score", (F.sum("n").over(down) - F.col("n")).alias("before"), F.expr(f"{int(percent)} * (sum(n) over ()) div 100").alias("take"))
    per = checked_broadcast(per.filter("before < take"))
    hit = able.join(per, "score")
    within = W.partitionBy("score").orderBy(doc_key(), "th", "n_words", "n_features", "weight").rowsBetween(W.unboundedPreceding, -1)
    hit = hit.withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(within), F.lit(0)))
    hit = hit.select(*row, "first", "take", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    rank = F.col("first") + F.col("copy")
    hit = hit.select(*row, F.when(rank <= F.col("take"), rank).alias("rank"))
    lower = each.join(per.select("score"), "score", "left_anti").unionByName(
        each.join(per.select("score"), "score", "left_semi").filter(F.col("n_words") < least_words))
    lower = lower.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*row, F.lit(None).cast("long").alias("rank"))
    return hit.unionByName(lower)


def importance_resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 2, buckets: int = 10_000, percent: int = 10,
                        least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every row of ``docs(doc_id, text)``: doc_id, th, n_words, n_features, weight, score, rank (null: not drawn).

    The draw takes floor(percent * N / 100) of the N rows with ``least_words`` words or more, by likeness of their
    ``low``- to ``high``-grams to those of ``target(text)``."""
    have = stored(scan(docs, low, high, buckets), "ngram-buckets")
    want = scan(target.select(F.lit(0).alias("doc_id"), "text"), low, high, buckets)
    gain = gains(bucket_counts(have, buckets), bucket_counts(want, buckets))
    scored = have.mapInArrow(_score(gain, seed), "doc_id long, th long, n_words long, n_features long, weight long, score long")
    return ranked(scored, percent, least_words)


def drawn(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of ``docs`` that were drawn (all copies of an id and text of which any was drawn)."""
    some = resampled.filter(F.col("rank").isNotNull()).select(doc_key().alias("doc"), "th").distinct()
    rows = docs.select(F.struct("*").alias("row"), doc_key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return rows.join(some, ["doc", "th"], "left_semi").select("row.*")
