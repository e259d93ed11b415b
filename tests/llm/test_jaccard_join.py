"""Chosen-path join against all pairs: links, classes, every path through the recursion."""

import random
import re

import numpy as np
import pytest

from intentloom.llm.jaccard_join import components, near_duplicates, runs_for, shingle_sets


def sets_of(t, w=5):
    ws = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t or "") if x]
    return frozenset(tuple(ws[i:i + w]) for i in range(len(ws) - w + 1)) if len(ws) >= w else frozenset({tuple(ws)} if ws else ())


def brute(rows, threshold=0.8):
    s = [sets_of(t) for _, t in rows]
    by = {}
    for i, x in enumerate(s):
        for g in x:
            by.setdefault(g, []).append(i)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        near = {j for g in s[i] for j in by[g]} - {i}
        for j in near:
            if len(s[i] & s[j]) >= threshold * len(s[i] | s[j]):
                links[i] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    key = lambda i: 1 << 63 if rows[i][0] is None else rows[i][0]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 63), key(i))
    name = lambda i: None if least[find(i)] == 1 << 63 else least[find(i)]
    return sorted(((rows[i][0], name(i), links[i]) for i in range(len(rows))), key=repr)


def corpus(seed, n=250):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(2000)] + ["é", "日本"]
    line = " ".join(rnd.choice(words) for _ in range(14))
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 120))] for _ in range(n // 3)]
    rows = []
    for i in range(n):
        ws = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            ws[rnd.randrange(len(ws))] = rnd.choice(words)
        t = " ".join(ws)
        rows.append((i, f"{line} \n{t}" if rnd.random() < 0.4 else t))
    cluster = [rnd.choice(words) for _ in range(100)]
    for i in range(n, n + 60):  # a large group of near copies
        ws = list(cluster)
        ws[rnd.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(ws)))
    rows += [(9000, None), (9001, ""), (9002, " \t"), (9003, "one"), (9004, "one"), (9005, "a b c d"), (9006, "a  b\nc d"), (9007, "a b c e"),
             (None, rows[0][1]), (None, "only null"), (5, rows[5][1]), (9008, " ".join(words * 10)), (9009, " ".join(words * 10) + " end")]
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"limit": 6, "block": 16, "runs": 40, "depth": 2})])
def test_links_and_classes(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, class_id int, sid string").repartition(4)
    got = near_duplicates(df, **options).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def near_group(n, seed):
    """Texts of 100 words with one word of their own: pairs lie at 86/106 = 0.81 (0.83 to 0.96 where the words are close)."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(n):
        ws = list(base)
        ws[rnd.randrange(4, 96)] = f"x{i}"
        rows.append((i, " ".join(ws)))
    return rows


@pytest.mark.parametrize("n,mixed", [(600, False), (600, True), (3000, False)])
def test_no_link_is_lost_in_large_groups(spark, n, mixed):
    rows = near_group(n, n)
    want = brute(rows) if n < 1000 else None
    if mixed:  # the group among many unlike texts that share its beginning, so that buckets are split
        head = " ".join(rows[0][1].split()[:12]) if "x" not in rows[0][1][:40] else " ".join(f"b{i}" for i in range(12))
        rows += [(10_000 + i, head + " " + " ".join(f"u{i}_{j}" for j in range(12))) for i in range(2500)]
        want = want + [(10_000 + i, 10_000 + i, 0) for i in range(2500)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).select("doc_id", "class_id", "n_links").collect()
    if want is None:  # a text's links by the places of its own word, which decide the similarity
        at = np.array([next(k for k, w in enumerate(t.split()) if w[0] == "x") for _, t in rows])
        gap = np.abs(at[:, None] - at[None, :])
        both = np.where(at[:, None] == at[None, :], 91, 86 + np.maximum(0, 5 - gap))
        links = (both >= 0.8 * (192 - both)).sum(1) - 1
        want = [(i, 0, int(links[i])) for i in range(n)]
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0])


def test_runs_follow_from_the_recall():
    assert runs_for(0.8, 1 - 2e-8, 2) == 12 and runs_for(0.8, 0.9, 2) < 3 and runs_for(0.5, 0.999, 2) > runs_for(0.8, 0.999, 2)


def test_one_row_is_first_in_each_class(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d  e f g"), (None, "p q r s t"), (None, ""), (3, "x y z u v"), (3, "x y z  u v"), (4, "x y z u v"), (9, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("first").collect()
    assert sorted(((r.doc_id, r.class_id, r.n_shingles) for r in got), key=repr) == sorted([(None, None, 3), (None, None, 1), (None, None, 0), (3, 3, 1), (9, 9, 0)], key=repr)


def test_shingles_do_not_cross_texts():
    texts = ["a b c d e f", "", "a b", "a b c d e f g", " a b", "x" * 50]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    tok, at = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), off, 5)
    assert np.diff(at).tolist() == [2, 0, 1, 3, 1, 1]
    assert set(tok[at[0]:at[1]]) < set(tok[at[3]:at[4]]) and tok[at[2]] == tok[at[4]]


def test_components_of_a_long_chain(spark):
    n = 200
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(n - 1) if i != 120]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for part in (ids[:121], ids[121:]):
        assert {got.get(x, x) for x in part} == {min(part)}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
