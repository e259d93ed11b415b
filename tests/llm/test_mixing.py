"""Mixing: water-filled targets, Sainte-Lague seats, what each document gives."""

import re

import pytest
from pyspark.sql import functions as F

from intentloom.llm.mixing import mix, mixed_documents, sainte_lague


def seats(weights, n):
    got = {p: 0 for p in weights}
    for _ in range(n):
        best = max((w / (2 * got[p] + 1), -i, p) for i, (p, w) in enumerate(sorted(weights.items())) if w > 0)
        got[best[2]] += 1
    return got


@pytest.mark.parametrize("weights,n", [({"a": 53, "b": 24, "c": 23}, 7), ({"a": 1000, **{f"p{i}": 1 for i in range(60)}}, 40),
                                       ({"a": 5, "b": 0, "c": 5}, 4), ({"a": 5, "b": 3}, 0), ({"x": 7, "y": 7, "z": 7}, 100)])
def test_highest_quotients(spark, weights, n):
    df = spark.createDataFrame([(0, p, float(w), n) for p, w in weights.items()], "g int, p string, w double, n long")
    got = {r.p: r.s for r in sainte_lague(df, ["g"], ["p"], "w", "n", "s").collect()}
    assert got == seats(weights, n)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def docs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90)), f"s{i % 4}" if i % 9 else None) for i in range(900)]
    rows += [(i, "x y z " * 20, "hot") for i in range(1000, 2000)]
    rows += [(5000, None, "s0"), (5001, "", "empty"), (5002, " \t\n", "empty"), (5003, "one " * 5000, "s1"), (None, "a b c", "s1"), (7, rows[7][1], rows[7][2])]
    return rows, spark.createDataFrame([(*r, "q", 9) for r in rows], "doc_id long, text string, source string, target string, size int").repartition(3)


def test_targets_and_taken(spark):
    rows, df = docs(spark)
    got = mix(df).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 16 * 24 for s in sizes)
    again = mix(df.repartition(7)).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mix(df).select("doc_id", "size", "taken").collect())


def test_documents_hold_the_words_taken(spark):
    rows, df = docs(spark)
    took = mix(df).filter("taken > 0").groupBy("source").agg(F.sum("taken").alias("n")).collect()
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    got = mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
    assert {r.source: r.n for r in got} == {r.source: r.n for r in took}


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
