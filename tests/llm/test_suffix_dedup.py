"""Suffix-array dedup against a brute-force window search."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from intentloom.llm.suffix_dedup import repeated_spans, suffix_dedup


def tag(text):
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, m=100):
    rows = [(1 << 63 if d is None else d, (t or "").encode(), d) for d, t in rows]
    seen = {}
    for d, t in sorted({(d, t) for d, t, _ in rows}, key=lambda r: (r[0], tag(r[1]))):
        for p in range(len(t) - m + 1):
            seen.setdefault(t[p:p + m], (d, t, p))
    out = []
    for d, t, doc_id in rows:
        gone = [False] * len(t)
        for p in range(len(t) - m + 1):
            if seen[t[p:p + m]] != (d, t, p):
                gone[p:p + m] = [True] * m
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((-1 if doc_id is None else doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde\u00e9") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rnd.randint(5, 200)) for _ in range(30)]
    passages = [text(30), text(12), text(60)]
    rows = []
    for i in range(150):
        t = rnd.choice(base) if rnd.random() < 0.3 else text(rnd.randint(1, 150))
        for _ in range(rnd.randint(0, 3)):
            k, p, a = rnd.randint(0, len(t)), rnd.choice(passages), rnd.randint(0, 20)
            t = t[:k] + p[a:len(p) - rnd.randint(0, 20)] + t[k:]
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, "a" * 1000), (503, "a" * 700), (504, "ab" * 300), (505, "x" * 99),
             (506, "x" * 100), (507, "x" * 100), (None, base[0]), (None, base[1]), (5, rows[5][1]),
             (6, base[2] + "zz"), (508, "\x00" * 200), (509, "\x00" * 150 + "q")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("cap", [512, 3])
def test_equals_brute_force(spark, cap):
    rows = corpus(cap)
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, bytes string, lo int").repartition(5)
    got = suffix_dedup(df, 100, cap).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows)


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    import intentloom.llm.suffix_dedup as m
    rows = corpus(9)
    text = {d: t or "" for d, t in rows}
    long = " ".join(t for t in text.values())
    data, small = long.encode(), 1 << 10
    monkeypatch.setattr(m, "SEGMENT", small)
    import numpy as np
    seen = set()
    for i, j, lo, hi in m._segments(np.array([0, len(data), len(data) + 50]), 100):
        seen |= set(range(lo, hi - 99)) if i == 0 else set()
    assert seen >= set(range(len(data) - 99))


def test_groups_list_every_occurrence(spark):
    p = "".join(random.Random(1).choice("abcdefgh ") for _ in range(150))
    rows = [(i, str(i) * 45 + p + str(i) * 36) for i in range(6)]
    spans = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = spans.groupBy("repeat").agg(F.countDistinct("doc").alias("docs"), F.count_if("first").alias("firsts")).collect()
    assert all(g.docs >= 2 and g.firsts == 1 for g in groups) and any(g.docs == 6 for g in groups)
    covered = spans.groupBy("doc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    assert all((r.lo, r.hi) == (45, 195) for r in covered)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def check_groups(rows, spans, m=100):
    """Each group is one string with every occurrence of it, its first marked; all repeated windows are listed."""
    texts = {}
    for d, t in rows:
        texts.setdefault(1 << 63 if d is None else d, set()).add((t or "").encode())
    assert all(len(t) == 1 for t in texts.values())
    texts = {d: t for d, (t,) in ((d, tuple(t)) for d, t in texts.items())}
    windows, groups, listed = {}, {}, set()
    for d, t in texts.items():
        for p in range(len(t) - m + 1):
            windows.setdefault(t[p:p + m], set()).add((d, p))
    for r in spans:
        d = 1 << 63 if r.doc == (1 << 63) - 1 else r.doc
        groups.setdefault(r.repeat, []).append((d, r.lo, r.hi, r.first))
        listed |= {(d, p) for p in range(r.lo, r.hi - m + 1)}
    for g in groups.values():
        text = {texts[d][lo:hi] for d, lo, hi, _ in g}
        assert len(text) == 1
        text, = text
        want = {(d, p) for d, p in windows[text[:m]] if texts[d][p:p + len(text)] == text}
        assert len(g) == len(want) > 1 and {(d, lo) for d, lo, _, _ in g} == want
        assert [(d, lo) for d, lo, _, first in g if first] == [min(want)]
    assert listed == {w for ws in windows.values() if len(ws) > 1 for w in ws}
    return groups


@pytest.mark.parametrize("cap", [512, 1])
def test_groups_list_copies_of_contexts(spark, cap):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p = text(130)
    contexts = [text(90) + p + text(90) for _ in range(3)] + [p, p + text(70)]  # the passage alone lies whole in the others
    rows = [(i, contexts[i % 5] if i < 40 else text(30) + p + text(20)) for i in range(43)]
    df = spark.createDataFrame(rows + [rows[7]], "doc_id long, text string").repartition(5)
    groups = check_groups(rows, repeated_spans(df, bucket_cap=cap).collect())
    assert max(map(len, groups.values())) == 43 and any(len(g) == 8 for g in groups.values())


@pytest.mark.parametrize("cap", [512, 3])
def test_groups_of_a_corpus(spark, cap):
    rows = [(d, t) for d, t in corpus(cap) if d is not None and d not in (5, 6) and (t or "")[:20] not in ("a" * 20, "ab" * 10, "\x00" * 20)]
    check_groups(rows, repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bucket_cap=cap).collect())


def small(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)


def test_texts_of_one_id_stay_apart(spark):
    rnd = random.Random(3)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = words(40)
    text = passage + " " + words(20)
    while True:  # an unrelated text whose hash ends in the same 14 bits
        other = words(60)
        if (tag(other) ^ tag(text)) & 0x3FFF == 0:
            break
    for doc_id in (7, None):
        rows = [(1, "start " + passage), (doc_id, text), (doc_id, other)]
        got = small(spark, rows)
        assert got == brute(rows) and sum(r[2] > 0 for r in got) == 1


def test_many_texts_without_id(spark):
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passages = [words(30) for _ in range(50)]
    rows = [(None, words(10) + " " + (rnd.choice(passages) if i % 3 else words(20)) + " " + words(10)) for i in range(2000)]
    rows += rows[:40] + [(3, rows[5][1]), (None, None)]
    assert small(spark, rows) == brute(rows)


def test_texts_are_stripped_in_parts(spark, monkeypatch):
    import intentloom.llm.suffix_dedup as m
    monkeypatch.setattr(m, "STRIP", 300)
    rows = corpus(21)
    assert small(spark, rows) == brute(rows)
