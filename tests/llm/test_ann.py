"""Multiprobe p-stable search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentloom.llm.ann import nearest
from tests.conftest import SF_SMALL


def brute(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    out = []
    for q in ok:
        if q % every == 0:
            s = sorted((-round(float((ok[q] * v).sum() / np.linalg.norm(ok[q]) / np.linalg.norm(v)), 9), i)
                       for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, r + 1, i, -c) for r, (c, i) in enumerate(s[:k])]
    return out


def compare(got, want, recall):
    got = {(r.query_id, r.vec_id): round(r.score, 9) for r in got}
    pairs = {(q, i): s for q, _, i, s in want}
    hit = set(got) & set(pairs)
    assert all(got[p] == pytest.approx(pairs[p]) for p in hit)
    assert len(hit) >= recall * len(pairs)
    return len(got), len(pairs)


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    got = nearest(df, F.col("vec_id") % 50 == 0).collect()
    n, m = compare(got, brute([(r.vec_id, r.embedding) for r in df.collect()]), 0.9)
    assert n == m


def test_copies_ties_and_invalid_rows(spark):
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(8).tolist()
    rows = [(i, hot) for i in range(0, 200)] + [(i, rng.standard_normal(8).tolist()) for i in range(200, 300)]
    rows += [(1000, None), (1001, [0.0] * 8), (1050, [float("nan")] * 8), (1100, [None, 1.0]), (None, hot), (1150, [1.0, 2.0]), (1200, [2.0, 4.1]),
             (250, rows[250][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = nearest(df, F.col("vec_id") % 50 == 0, block=16).collect()
    hot_rows = {(r.query_id, r.rank): r.vec_id for r in got if r.query_id < 200}
    assert [hot_rows[0, r] for r in range(1, 6)] == [1, 2, 3, 4, 5] and [hot_rows[150, r] for r in range(1, 6)] == [0, 1, 2, 3, 4]
    n, m = compare(got, brute(rows), 0.9)
    assert n == m and {r.query_id for r in got} == {0, 50, 100, 150, 200, 250, 1150, 1200}


def test_few_rows_give_all(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in sorted(nearest(df, F.col("vec_id") == 0).collect(), key=lambda r: r.rank)] == [(1, 2), (2, 1)]


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.standard_normal(6 + i % 2).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, nearest(df, F.col("vec_id") % 5 == 0, query_block=b, block=64).collect())) for b in (16_384, 7))
    assert one == many and len(one) == 400


def test_many_vectors_on_one_direction(spark):
    rng = np.random.default_rng(4)
    one = rng.standard_normal(8)
    rows = [(i, (one * 2.0 ** (i % 40)).tolist()) for i in range(800)] + [(1000 + i, rng.standard_normal(8).tolist()) for i in range(50)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=64).collect()
    for q in range(0, 800, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [v for _, v, _ in mine] == [i for i in range(6) if i != q][:5] and all(s == pytest.approx(1.0) for *_, s in mine)
