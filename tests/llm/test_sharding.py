"""Hilbert shards: the law, gapless slots, the curve itself, pruning."""

import itertools
import random
import zlib

from pyspark.sql import functions as F

from intentloom.llm.sharding import hilbert_index, hilbert_shards, write_shards
from intentloom.session import shared_dir
from tests.conftest import SF_SMALL


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = list(itertools.product(range(1 << bits), repeat=dims))
        names = [f"c{i}" for i in range(dims)]
        rows = hilbert_index(spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names)), names, bits).orderBy("hilbert").collect()
        assert [r.hilbert for r in rows] == list(range(len(cells)))
        steps = [sum(abs(a[n] - b[n]) for n in names) for a, b in zip(rows, rows[1:])]
        assert set(steps) == {1}


def check(rows, got, shards):
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_law_with_copies_nulls_and_clashing_columns(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 40), None if i % 7 == 0 else "en", f"s{i % 5}") for i in range(203)]
    rows += [(None, None, None, None), (5, None, "en", "s"), (5, "", "en", "s"), (7, rows[7][1], "en", "s2"), (9000, "é" * 50000, "fr", None)]
    df = spark.createDataFrame([(*r, 3, 1) for r in rows], "doc_id long, text string, lang string, source string, shard int, rank int")
    got = hilbert_shards(df, 40).collect()
    check(rows, got, 40)
    # copies lie side by side
    place = sorted(((r.shard, r.slot), r.doc_id) for r in got)
    at = [i for i, (_, d) in enumerate(place) if d is not None and d % 3 == 0 and d < 203 and d != 9000]
    same = [i for i in at if place[i][1] not in (5, 7)]
    assert max(same) - min(same) < len(same) + 3


def test_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check([(r.doc_id, r.text) for r in df.collect()], hilbert_shards(df, 40).collect(), 40)


def test_files_prune(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang"),
                                  F.concat(F.lit("s"), F.xxhash64("id") % 8).alias("source"))
    df = df.withColumn("text", F.concat("text", "doc_id"))
    bounds = write_shards(df, shared_dir(spark, "hilbert"), 32).collect()
    assert sum(r["rows"] for r in bounds) == 2000
    hit = [b for b in bounds if b.min_lang <= "l2" <= b.max_lang]
    assert len(hit) <= len(bounds) * 0.6  # an unsorted layout would touch every file


def test_empty(spark):
    assert hilbert_shards(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def plain_index(cell, bits):
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= (q - 1) if x[-1] & q else 0
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_order_of_the_quantised_rows(spark):
    import math
    rnd = random.Random(6)
    source = lambda i: rnd.choice([None, *(f"https://a.long/common/beginning/{k:03d}" for k in range(30))])
    rows = [(i, f"text {i} " * rnd.randrange(1, 50), rnd.choice(["en-long-name-a", "en-long-name-b", None]), source(i)) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1], "zz", "other") for i in range(120)] + [(None, "no id", "de", None), (7, "again", "de", "x")]
    got = hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), 8).collect()
    key = lambda r: (1 << 63) - 1 if r[0] is None else r[0]
    first = {}
    for r in sorted(rows, key=key):
        first.setdefault(r[1], r)
    place = lambda col, v: -math.inf if v is None else float(sorted({r[col] for r in rows if r[col] is not None}).index(v))
    dims = [[place(2, first[r[1]][2]), place(3, first[r[1]][3]), float(len(r[1])), float(key(first[r[1]]))] for r in rows]
    cells = []
    for d in range(4):
        v = sorted(x[d] for x in dims)
        cuts = [v[math.ceil(p * len(v) / 16) - 1] for p in range(1, 16)]
        cells.append([sum(x[d] > c for c in cuts) for x in dims])
    want = {}
    for r, *cell in zip(rows, *cells):
        want.setdefault((r[0], len(r[1]) + 16), []).append(plain_index(cell, 4))
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r["size"]), []).append(r.hilbert)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_prunes_by_the_end_of_long_names(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id").alias("text"), F.lit("en").alias("lang"),
                                  F.concat(F.lit("common-crawl-"), F.xxhash64("id") % 8 + 2010).alias("source"))
    bounds = write_shards(df, shared_dir(spark, "hilbert"), 32).collect()
    assert len([b for b in bounds if b.min_source <= "common-crawl-2012" <= b.max_source]) <= len(bounds) * 0.6


def test_hot_keys_beside_others(spark, monkeypatch):
    import intentloom.llm.common as m
    monkeypatch.setattr(m, "_HOT_KEYS", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 5 == 0 else f"k{i % 30}") for i in range(300)], "i long, k string")
    found = spark.createDataFrame([("hot", 150, 1), *((f"k{i}", 5, i + 2) for i in range(0, 30, 4))], "k string, n long, v int")
    got = {r.i: (r.k, r.v) for r in m.lookup(rows, found, "k", 300).collect()}
    value = {r.k: r.v for r in found.collect()}
    assert got == {r.i: (r.k, value.get(r.k)) for r in rows.collect()} and m.lookup(rows, found, "k", 300).count() == 300
    test_law_with_copies_nulls_and_clashing_columns(spark)
