"""Whitening: fit list, eigenpairs and images against numpy's dense solver; MINRES and Jacobi-Davidson by themselves."""

import math
from collections import defaultdict

import numpy as np
import pytest

from intentloom.llm.whitening import jacobi_davidson, minres, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, n string, x int, component double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", None, 0.5) for i, v in rows], SCHEMA).repartition(4)


def plain(rows, k=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = defaultdict(int)
    for _, v in good:
        sizes[len(v)] += 1
    d = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good if len(v) == d]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in good]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    images = [(i, np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vector / np.sqrt(np.maximum(value, 1e-300))) for i, x in good]
    return n, dev, value, value / np.trace(cov), images


def hold(spark, rows, k=16, components=None):
    got = whiten(frame(spark, rows), k).collect()
    n, dev, value, share, images = plain(rows, k)
    use = components if components is not None else len(value)
    assert len(got) == use * len(dev) and {r.n for r in got} == {n}
    assert sorted({(repr(r.vec_id), r.deviation) for r in got}) == sorted({(repr(i), d) for i, d in dev})
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    by = defaultdict(list)
    for r in got:
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        by[r.component].append((repr(r.vec_id), r.whitened))
    for c in range(1, use + 1):
        want = sorted((repr(i), w[c - 1]) for i, w in images)
        have = sorted(by[c])
        assert [a for a, _ in want] == [a for a, _ in have]
        want, have = np.array([b for _, b in want]), np.array([b for _, b in have])
        assert min(np.abs(have - want).max(), np.abs(have + want[:]).max()) < 1e-6 or np.allclose(np.sort(np.abs(have)), np.sort(np.abs(want)), atol=1e-6)


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(24) * np.linspace(3, 0.3, 24)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[9][1]), (2000, [0.0] * 24)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 23), (3003, [1.0] * 23 + [None]), (3004, [float("nan")] * 24), (3005, [float("inf")] + [0.0] * 23)]
    hold(spark, rows)


def test_few_dimensions_and_low_rank(spark):
    rng = np.random.default_rng(2)
    hold(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 3)) * [5, 2, 1])])
    flat = rng.integers(-9, 9, (80, 5)) @ rng.integers(-3, 4, (5, 40))
    hold(spark, [(i, (v / 64).tolist()) for i, v in enumerate(flat)], components=5)
    hold(spark, [(0, [1.0] * 30), (1, [2.0] * 30)], components=1)


def test_no_variance_and_empty(spark):
    assert whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    assert whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whiten(frame(spark, [])).count() == 0


def test_deviation_beyond_doubles(spark):
    rows = [(0, [2.0 ** 22, 0.1]), (1, [0.0, 0.9]), (2, [3.0, 77.7])]
    assert {r.deviation for r in whiten(frame(spark, rows), 2).collect()} == {d for _, d in plain(rows)[1]}


@pytest.mark.parametrize("seed", range(4))
def test_solvers(seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    value = np.sort(np.concatenate([np.repeat(rng.random(6) * 9, 4), rng.random(36)]))[::-1] if seed % 2 else np.geomspace(100, 1e-3, 60)
    a = (q * value) @ q.T
    calls = []
    theta, u = jacobi_davidson(lambda b: calls.append(b.shape) or a @ b, 60, 12)
    assert np.abs(theta - value[:12]).max() < 1e-12 * value[0] and np.abs(a @ u - u * theta).max() < 1e-12 * value[0]
    assert np.abs(u.T @ u - np.eye(12)).max() < 1e-13 and len(calls) < 200
    rhs, shift = rng.standard_normal((60, 5)), np.array([200.0, -1, 300, -50, 0.0])
    x = minres(lambda b, j: a @ b + b * shift[j], rhs, 400, 1e-10)
    ok = shift != 0
    assert np.abs(a @ x + x * shift - rhs)[:, ok].max() < 1e-7
