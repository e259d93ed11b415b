"""The pivot index: the rows of the full scan, and few balls visited where candidates are clustered."""

import random

import pytest
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.operators import metric_index as MI
from intentloom.operators import score as SC


def clustered(seed, n, clusters, dim=8):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-20, 20) for _ in range(dim)] for _ in range(clusters)]
    return [[x + rnd.gauss(0, 0.2) for x in rnd.choice(centres)] for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    points = clustered(1, 1200, 25)
    cands = [("big" if i % 3 else "small", f"l{i:04d}", p) for i, p in enumerate(points)]
    cands += [("big", "zero", [0.0] * 8), ("big", "tie1", points[1]), ("big", "atie", points[1]), (None, "none", points[0]), ("big", "nothing", None)]
    rnd = random.Random(2)
    queries = [(i, rnd.choice(["big", "small", "big", "absent", None]), [x + rnd.gauss(0, 0.3) for x in rnd.choice(points)]) for i in range(400)]
    queries += [(900, "big", [0.0] * 8), (901, "small", None), (902, "big", points[1])]
    return (spark.createDataFrame(queries, "uid long, scope string, vec array<double>").repartition(4),
            spark.createDataFrame(cands, "scope string, label string, proto array<double>").repartition(3))


@pytest.mark.parametrize("block_bytes", [None, 40_000])
def test_same_rows_as_the_scan(tables, block_bytes):
    queries, cands = tables
    some = cands.where("proto is not null")
    for run in (lambda **o: SC.nearest_prototype(queries, some, **o), lambda **o: SC.zero_shot_cosine(queries, cands, lvec="proto", **o)):
        plain, indexed = (sorted(map(tuple, run(index=i, block_bytes=block_bytes if i else None).collect()), key=repr) for i in (False, True))
        assert plain == indexed and len(plain) == 403
    assert {r[0]: r[1] for r in map(tuple, SC.nearest_prototype(queries, some, index=True).collect())}[902] == "atie"


def test_few_balls_are_visited(tables):
    queries, cands = tables
    p = cands.where("proto is not null").select("scope", "label", F.col("proto").alias("__p"))
    got = MI.nearest(queries.where("vec is not null and scope in ('big', 'small')"), p, lambda c: F.round(V.l2_dist("vec", c["__p"]), 9), lambda d: d)
    visited, balls = got.agg(F.avg("visited"), F.avg("balls")).first()
    assert balls > 15 and visited < 0.2 * balls
    assert MI.balls(p, "scope", "__p").agg(F.sum(F.size("members"))).first()[0] == p.count()
