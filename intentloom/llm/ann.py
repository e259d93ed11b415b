"""Approximate nearest neighbours: multiprobe p-stable hashing.

Vectors are scaled to length one, so the largest cosine is the least Euclidean distance.
Each of ``tables`` tables projects them on ``width`` Gaussian (2-stable) directions, shifts
and cuts the line into cells of length ``cell``; the cells' numbers make the bucket.  A query
visits its own bucket and the buckets with some numbers moved by one, in the order of
estimated success: the sum of squared distances from the query's projections to the
borders that it would have crossed, least first (``probes`` of them per table).  The
candidates of all tables merge, and their cosines are computed exactly in double.

Plan: equal vectors are searched once (a vector that a third of all rows share is one
row).  Buckets over ``block`` rows are cut into blocks, so no bucket is one task's work;
queries travel once per block group with all of their probes that fall into it, in blocks of
``query_block`` queries (the group's rows come once per block of queries), and each group returns only the k best of each query.  The index covers every row; nothing is fitted.
Queries that find fewer than ``k`` rows are searched exactly, in blocks of rows.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part; vectors of different lengths do not meet; rows repeated whole
count once; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intentloom.llm.common import mix, stored

_MARGIN = 1e-9  # of matrix products, before cosines are computed pair by pair


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(table: int, cells: np.ndarray) -> np.ndarray:
    h = np.full(cells.shape[:-1], table + 1, np.uint64)
    for m in range(cells.shape[-1]):
        h = mix(h ^ (cells[..., m].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return h.view(np.int64)


def _projections(dim: int, tables: int, width: int, cell: float, seed: int):
    rng = np.random.Generator(np.random.PCG64(seed * 1_000_003 + dim))
    for t in range(tables):
        yield t, rng.standard_normal((dim, width)), rng.uniform(0, cell, width)


def _hash(probes: int, tables: int, width: int, cell: float, seed: int):
    """Vectors -> codes: the bucket in each table, or (probes > 1) the buckets in visiting order."""
    moves = np.array(list(itertools.product((0, -1, 1), repeat=width)), np.int8)

    def codes(x):
        n, out = len(x), []
        for t, a, shift in _projections(x.shape[1], tables, width, cell, seed):
            p = (x @ a + shift) / cell
            cells = np.floor(p).astype(np.int64)
            if probes == 1:
                out.append(_code(t, cells)[:, None])
                continue
            f = p - cells
            cost = np.stack([np.zeros_like(f), (1 - f) ** 2, f ** 2], 2)  # of moving by 0, 1, -1
            score = sum(cost[:, m, :][:, moves[:, m]] for m in range(width))
            best = np.argsort(score, axis=1, kind="stable")[:, :probes]
            out.append(_code(t, cells[:, None, :] + moves[best]))
        return np.concatenate(out, 1) if n else np.zeros((0, 1), np.int64)

    def run(batches):
        for b in batches:
            dims = pc.list_value_length(b.column("vec"))
            same = [b.filter(pc.equal(dims, d)) for d in pc.unique(dims)]
            for part in (x.slice(i, 256) for x in same for i in range(0, x.num_rows, 256)):
                got = codes(_unit(_matrix(part.column("vec"))))
                lists = pa.ListArray.from_arrays(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32), got.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "codes"])
    return run


def _best(q, x, ids, k):
    """For each query row the rows of ``x`` that can be among its k best: (query, row) pairs."""
    s = q @ x.T
    if len(ids) <= k:
        return np.repeat(np.arange(len(q)), len(ids)), np.tile(np.arange(len(ids)), len(q))
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
    return np.nonzero(s >= least - _MARGIN)


_HITS = "qid long, uid long, score double"


def _search(k: int):
    """One group of buckets (or of blocks of them) with the queries that probe it -> hits."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not rows.num_rows or not queries.num_rows:
            return empty
        code = rows.column("slot").to_numpy()
        order = np.argsort(code, kind="stable")
        code, uid = code[order], rows.column("uid").to_numpy()[order]
        raw = _matrix(rows.column("vec"))[order]
        norm = np.linalg.norm(raw, axis=1)
        x = raw / norm[:, None]
        slots = queries.column("slots").combine_chunks()
        owner = np.repeat(np.arange(queries.num_rows), np.diff(np.asarray(slots.offsets)))
        probe = slots.flatten().to_numpy()
        o = np.argsort(probe, kind="stable")
        owner, probe = owner[o], probe[o]
        qid, qraw = queries.column("qid").to_numpy(), _matrix(queries.column("vec"))
        qnorm = np.linalg.norm(qraw, axis=1)
        qx = qraw / qnorm[:, None]
        found_q, found_r = [], []
        for c in np.unique(probe):
            lo, hi = np.searchsorted(code, c), np.searchsorted(code, c, "right")
            if lo < hi:
                mine = owner[np.searchsorted(probe, c):np.searchsorted(probe, c, "right")]
                for i in range(0, len(mine), 512):
                    a, b = _best(qx[mine[i:i + 512]], x[lo:hi], uid[lo:hi], k)
                    found_q.append(mine[i:i + 512][a])
                    found_r.append(b + lo)
        if not found_q:
            return empty
        a, b = np.concatenate(found_q), np.concatenate(found_r)
        score = np.concatenate([(qraw[a[i:i + 8192]] * raw[b[i:i + 8192]]).sum(1) for i in range(0, len(a), 8192)]) / (qnorm[a] * norm[b])
        ids = uid[b]
        # the k best of each query, each row once (it can be in several tables' buckets)
        s = np.lexsort((ids, a))
        a, ids, score = a[s], ids[s], score[s]
        keep = np.append(True, (a[1:] != a[:-1]) | (ids[1:] != ids[:-1]))
        a, ids, score = a[keep], ids[keep], score[keep]
        s = np.lexsort((-score, a))
        a, ids, score = a[s], ids[s], score[s]
        start = np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1]), np.arange(len(a)), 0))
        kth = score[np.minimum(start + k - 1, len(a) - 1)]
        keep = (np.arange(len(a)) - start < k) | (score >= kth - _MARGIN)
        return pa.table({"qid": qid[a[keep]], "uid": ids[keep], "score": score[keep]})
    return run


def _grouped(rows: DataFrame, queries: DataFrame, k: int, query_blocks: int) -> DataFrame:
    """Each part's rows meet its queries block by block, so that both sides of a task are bounded."""
    if query_blocks > 1:
        rows = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        queries = queries.withColumn("qb", F.pmod("qid", F.lit(query_blocks)).cast("int"))
    by = ["dim", "part"] + ["qb"] * (query_blocks > 1)
    return rows.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(_search(k), _HITS)


def nearest(vectors: DataFrame, is_query, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 8,
            width: int = 8, cell: float = 2.0, probes: int = 120, block: int = 4096, query_block: int = 16_384, seed: int = 7) -> DataFrame:
    """The ``k`` nearest rows found (largest cosine) of each row where ``is_query``: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the id column's name ``vec_id``.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & F.expr("exists(vec, x -> x <> 0)"))
    v = v.distinct()
    # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest
    key = v.withColumn("uid", F.xxhash64("vec"))
    ranked = key.withColumn("n", F.row_number().over(W.partitionBy("uid", "vec").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = stored(ranked.groupBy("uid", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                     .withColumn("dim", F.size("vec")), "ann-vectors")
    queries = stored(key.filter(is_query).select("vec_id", "uid"), "ann-queries")
    asked = stored(members.join(queries.select("uid").distinct(), "uid").select(F.col("uid").alias("qid"), "vec", "dim"), "ann-asked")

    make = lambda n: _hash(n, tables, width, cell, seed)
    index = stored(members.select("uid", "dim", "vec").mapInArrow(make(1), "uid long, dim int, vec array<double>, codes array<long>")
                   .select("uid", "dim", F.explode("codes").alias("code")), "ann-index")
    counts = index.groupBy("code").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n"))
    total = index.count()
    parts = max(1, math.ceil(total / (4 * block)))
    # where a block of a bucket lies; its number tells buckets that share a part apart
    slot = F.xxhash64("code", "sub")
    part = F.pmod(slot, F.lit(parts)).cast("int")
    counts = stored(counts, "ann-buckets")
    placed = (index.join(counts, "code").withColumn("sub", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
              .select("uid", "dim", slot.alias("slot"), part.alias("part")))
    rows = placed.join(members.select("uid", "vec"), "uid").select("dim", "part", "slot", "uid", "vec")
    probed = (asked.mapInArrow(make(probes), "qid long, vec array<double>, dim int, codes array<long>")
              .select("qid", "dim", F.explode("codes").alias("code")).join(counts, "code")
              .withColumn("sub", F.explode(F.expr("sequence(0, blocks - 1)")))
              .select("qid", "dim", slot.alias("slot"), part.alias("part"))
              .groupBy("qid", "dim", "part").agg(F.collect_list("slot").alias("slots")))
    wanted = probed.join(asked.select("qid", "vec"), "qid").select("dim", "part", "qid", "vec", "slots")
    query_blocks = math.ceil(asked.count() / query_block)
    hits = stored(_grouped(rows, wanted, k + 1, query_blocks), "ann-hits")

    # queries that found too few rows: all rows, in blocks
    have = (hits.select("qid", "uid").distinct().join(members.select("uid", F.size("ids").alias("m")), "uid")
            .groupBy("qid").agg(F.sum("m").alias("m")))
    lacking = asked.join(have, "qid", "left").filter(F.coalesce("m", F.lit(0)) <= k).select("qid", "vec", "dim")
    lacking = stored(lacking, "ann-lacking")
    if lacking.limit(1).count():
        parts = max(1, math.ceil(total / tables / block))
        all_rows = members.select("dim", F.pmod("uid", F.lit(parts)).cast("int").alias("part"), F.lit(0).cast("long").alias("slot"), "uid", "vec")
        every = lacking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) \
            .select("dim", "part", "qid", "vec", F.array(F.lit(0).cast("long")).alias("slots"))
        hits = hits.unionByName(_grouped(all_rows, every, k + 1, math.ceil(lacking.count() / query_block)))

    # the k + 1 best of each distinct query vector, then each query without itself
    flat = (hits.groupBy("qid", "uid").agg(F.max("score").alias("score")).join(members.select("uid", "ids"), "uid")
            .select("qid", "score", F.explode("ids").alias("vec_id")))
    best = (flat.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near")))
    per_query = queries.join(best, queries.uid == best.qid).select(F.col("vec_id").alias("query_id"), F.expr(
        f"slice(filter(near, x -> x.vec_id <> vec_id), 1, {k})").alias("near"))
    return (per_query.select("query_id", F.posexplode("near").alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")))
