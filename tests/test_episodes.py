"""Episode draws: without replacement, independent between episodes, whole repeats where a class is short."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from intentloom.operators import episodes as EP
from intentloom.operators.rank import class_rank, rows_at_ranks
from intentloom.functions.order import seeded_key


def drawn(spark, n, m, episodes=300):
    classes = spark.range(episodes).select(F.col("id").cast("int").alias("episode"), F.lit("c").alias("label"), F.lit(0).alias("class_id"))
    sizes = spark.createDataFrame([("c", n)], "label string, __n long")
    by = {}
    for r in EP.draw_ranks(classes, sizes, m, "t").collect():
        by.setdefault(r.episode, {})[r.slot] = r["__rn"]
    assert all(sorted(v) == list(range(m)) for v in by.values())
    return [[v[i] for i in range(m)] for _, v in sorted(by.items())]


def test_draws_are_without_replacement_and_spread(spark):
    draws = drawn(spark, 20, 4)
    assert len(draws) == 300 and all(len(set(d)) == 4 and set(d) <= set(range(1, 21)) for d in draws)
    assert len({tuple(sorted(d)) for d in draws}) > 250  # samples, not n runs of neighbours
    count = Counter(x for d in draws for x in d)
    assert len(count) == 20 and max(count.values()) < 2 * min(count.values())
    first = Counter(d[0] for d in draws)  # the order is random too
    assert len(first) == 20 and max(first.values()) < 40


@pytest.mark.parametrize("n,m", [(5, 5), (3, 7), (1, 4), (4, 8)])
def test_short_classes_repeat_whole(spark, n, m):
    for d in drawn(spark, n, m, 20):
        c = Counter(d)
        assert len(c) == n and set(c.values()) <= {m // n, -(-m // n)}


def test_rows_at_ranks_equal_class_ranks(spark):
    df = spark.range(500).select(F.col("id").alias("uid"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 7)).alias("label"))
    df = df.withColumn("h", seeded_key("uid", salt="x"))
    ranks = {(r.label, r.rn): r.uid for r in class_rank(df, ["label"], "h", "uid").collect()}
    wanted = spark.createDataFrame([("hot", i, j) for i in (1, 50, 167) for j in (1, 2)] + [("l1", 1, 9), ("l1", 3, 9), ("l9", 1, 1), ("hot", 999, 1)],
                                   "label string, __rn long, tag int")
    for prefix in (1, 4):
        got = rows_at_ranks(df, wanted, "label", "h", "uid", prefix_len=prefix).collect()
        assert sorted((r.label, r["__rn"], r.tag, r.uid) for r in got) == sorted(
            (r.label, r["__rn"], r.tag, ranks[r.label, r["__rn"]]) for r in wanted.collect() if (r.label, r["__rn"]) in ranks)


def test_support_and_query_tables(spark):
    rows = spark.range(200).select(F.col("id").alias("uid"), (F.col("id") % 4).cast("string").alias("label"))
    classes = EP.episode_classes(rows, 10, 2, extra=2)
    assert {r.n for r in classes.groupBy("episode").agg(F.countDistinct("label").alias("n")).collect()} == {4}
    apart = EP.episode_samples(rows, classes, 3, 5).collect()
    per = {}
    for r in apart:
        per.setdefault((r.episode, r.class_id), []).append(r.uid)
    assert len(per) == 40 and all(len(set(v)) == 8 for v in per.values())
    two = EP.episode_samples(rows.where("uid < 100"), classes, 3, 5, queries=rows.where("uid >= 100")).collect()
    assert len(two) == 40 * 8
    assert all((r.uid < 100) == (r.role == "support") and int(r.label) == r.uid % 4 for r in two)
