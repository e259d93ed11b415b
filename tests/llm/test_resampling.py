"""Importance resampling: spans of the overlapped scan, gains, scores and ranks against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from intentloom.llm.resampling import collapsed, drawn, importance_resample, scan


def plain_features(text, low, high):
    ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(ws), [b" ".join(ws[i:i + n]) for n in range(low, high + 1) for i in range(len(ws) - n + 1)]


def plain(docs, target, low, high, buckets, percent, least):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in plain_features(t, low, high)[1])
    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for d, text in docs:
        n, f = plain_features(text, low, high)
        weight = sum(gain(zlib.crc32(x) % buckets) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


ODD = [None, "", " \t\n", "A", "don't STOP-me_now 42", "é È ünï 漢字 a", "x" * 100_000, "one two  three\x7ffour\x00five", "Z" * 40 + " " * 50_000 + "y", "KK \U0001F600 b"]


@pytest.mark.parametrize("text", ODD)
def test_collapse(text):
    assert collapsed((text or "").encode()) == b" ".join(plain_features(text, 1, 1)[1])


@pytest.mark.parametrize("low,high,buckets", [(1, 1, 10_000), (1, 3, 97), (2, 2, 70_000)])
def test_brute_force(spark, low, high, buckets):
    docs = [(i, t) for i, t in enumerate(ODD)]
    docs += [(100 + i, " ".join(f"w{(i * j) % 37}" for j in range(i % 60))) for i in range(600)]
    docs += [(2000 + i, "same hot text of many words " * 5) for i in range(300)]
    docs += [(None, "null id " * 20), (None, "null id " * 20), (None, "other text " * 15), (130, "w1 " * 25), (130, "w1 " * 25), (5000, "deep sea " * 40_000)]
    target = ["deep sea w1 w3 w7", None, "", "W5 w6, w7"]
    df = spark.createDataFrame([(*d, "x", 1, 2.0) for d in docs], "doc_id long, text string, th string, score long, rank double").repartition(5)
    tf = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, doc_id long")
    got = importance_resample(df, tf, low, high, buckets, 30, 20).collect()
    want = plain(docs, target, low, high, buckets, 30, 20)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr) == want


def test_drawn_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(i, f"alpha beta {i} " * 10, i) for i in range(50)], "doc_id long, text string, th long")
    none = df.filter("false")
    out = importance_resample(df, df.limit(3), 1, 2, 100, 20)
    kept = drawn(df, out)
    assert kept.columns == df.columns and kept.count() == 10
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out.filter(F.col("rank").isNotNull()).collect()}
    assert importance_resample(none, df).count() == 0
    assert importance_resample(df, none).filter(F.col("rank").isNotNull()).count() == 5
    assert scan(none).count() == 0
