"""Bottom-k sketches: next and edited texts, estimates against exact sets, merging."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from intentloom.llm.fingerprints import containment, distinct_shingles, fingerprints, merge, merge_groups, resemblance, sketch


def shingles(t, w=5):
    ws = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
    return {tuple(ws[i:i + w]) for i in range(len(ws) - w + 1)} if len(ws) >= w else {tuple(ws)} if ws else set()


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def rows_():
    rnd = random.Random(2)
    vocab = ["wörd", "a", "bé", "cc", "dd ", "x\ty"] + [f"w{i}" for i in range(300)]
    rows = [(i * 3, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(i * 3 + 1, rows[i][1]) for i in range(0, 300, 10)]
    rows += [(1_000_000, "long " + " ".join(str(i) for i in range(9000))), (1_000_001, None), (1_000_002, ""), (None, "null id text here"), (3, rows[1][1])]
    return rows


def test_against_exact_sets(spark):
    rows = rows_()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, next_text int, sk string").repartition(4)
    got = fingerprints(df).collect()
    assert len(got) == len(rows)
    key = lambda d: 1 << 63 if d is None else d
    order = sorted(((key(d), t or "") for d, t in rows), reverse=True)
    assert len({k for k, _ in order}) == len(order) - 1  # one id twice, with equal texts
    nxt = {order[i]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    twice = (3, rows[1][1])
    text = {d: t or "" for d, t in rows}
    for r in got:
        t = text[r.doc_id]
        if (r.doc_id, t) == twice:
            continue
        follow = nxt[key(r.doc_id), t]
        h = len(t) // 2
        e = t[:len(t) - h] + follow[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        small = max(len(shingles(x)) for x in (t, e, follow)) < 128
        for near, other in ((r.near_edited, e), (r.near_next, follow)):
            exact = jaccard(shingles(t), shingles(other))
            assert abs(near - exact) < (1e-12 if small and len(shingles(t) | shingles(other)) <= 128 else 0.2)
        assert abs(r.distinct_shingles - len(shingles(t))) <= 0.35 * len(shingles(t))
    by = {}
    for r in got:
        by.setdefault(text[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_merge_and_containment(spark):
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    df = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, c string")
    df = df.select(sketch(F.col("a")).alias("a"), sketch(F.col("b")).alias("b"), sketch(F.col("c")).alias("c"))
    r = df.select(merge(F.col("a"), F.col("b")).alias("m"), "c", resemblance(F.col("a"), F.col("b")).alias("j"),
                  containment(F.col("a"), F.col("c")).alias("in_c"), distinct_shingles(F.col("a")).alias("n")).first()
    assert r.m == r.c and abs(r.j - 0.5) < 0.15 and r.in_c == 1.0 and abs(r.n - 2996) < 900
    parts = df.select(F.lit(1).alias("g"), F.col("a").alias("s")).union(df.select(F.lit(1), F.col("b")))
    assert merge_groups(parts, "g", "s").first().s == r.c


def test_one_row_and_empty(spark):
    one = fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 11
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_rows_of_one_id_are_dealt_to_blocks(spark):
    import xxhash
    from intentloom.llm.common import doc_key
    from intentloom.llm.fingerprints import _blocks
    rows = [(None, f"text {i} " * (3 + i % 5)) for i in range(500)] + [(i, f"numbered {i} words and more") for i in range(60)] + [(7, f"again {i} of seven") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tag = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (1 << 63 if r[0] is None else r[0], tag(r[1])), reverse=True)
    follow = {t: order[(i + 1) % len(order)][1] for i, (_, t) in enumerate(order)}
    half = lambda t: t[:len(t) - len(t) // 2] + follow[t][:len(t) // 2]
    want = sorted((len(t), hashlib.sha256(half(t).encode()).hexdigest()) for _, t in rows)
    assert sorted((r.n_chars, r.edited_sha256) for r in fingerprints(df).collect()) == want
    keyed = df.select(doc_key().alias("_key"), F.xxhash64("text").alias("_th"))
    sizes = [r["count"] for r in _blocks(keyed, 16)(keyed).groupBy("_block").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * len(rows) / 16
