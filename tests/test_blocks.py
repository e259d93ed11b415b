"""Candidates in one block or in many give the same rows; no row is lost, repeated or merged."""

import pytest
from pyspark.sql import functions as F

from intentloom.operators import evaluate as E
from intentloom.operators import joins
from intentloom.operators import pairs as P
from intentloom.operators import score as SC

BOUNDS = (None, 600)


@pytest.fixture(scope="module")
def queries(spark):
    # a repeated key, a scope without candidates, a null scope, a null and a zero vector
    rows = [(1, "s", "a", [0.0, 1.0]), (1, "s", "b", [5.0, 5.0]), (2, "t", "a", [1.0, 1.0]), (3, "none", "a", [1.0, 1.0]),
            (4, None, "a", [1.0, 1.0]), (5, "s", "a", None), (6, "s", "a", [0.0, 0.0])]
    return spark.createDataFrame(rows, "uid long, scope string, label string, vec array<double>")


@pytest.fixture(scope="module")
def cands(spark):
    rows = [("s", f"l{i:02d}", [float(i % 7), float(i % 5)]) for i in range(30)] + [("t", "b", [1.0, 1.0]), ("t", "a", [1.0, 1.0])]
    return spark.createDataFrame(rows, "scope string, label string, proto array<double>")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_blocks_hold_every_candidate_once(cands):
    blocks = joins.candidate_blocks(cands, cands.columns, 500)
    assert len(blocks) > 3
    got = sorted(c["scope"] + c["label"] for b in blocks for c in b.first()[0])
    assert got == sorted(r.scope + r.label for r in cands.collect())


def test_nearest_prototype_at_any_size(queries, cands):
    one, many, *indexed = (rows_of(SC.nearest_prototype(queries, cands, carry=("label",), block_bytes=b, index=i)) for i in (False, True) for b in BOUNDS)
    assert one == many and len(one) == 7 and indexed == [one, one]
    by = {(r[0], r[1]): r[2] for r in one}
    assert by[2, "a"] == "a" and by[3, "a"] is None and by[4, "a"] is None and by[1, "b"] is not None


def test_zero_shot_at_any_size(queries, cands):
    one, many, *indexed = (rows_of(SC.zero_shot_cosine(queries, cands, lvec="proto", carry=("label",), block_bytes=b, index=i)) for i in (False, True) for b in BOUNDS)
    assert one == many and len(one) == 7 and indexed == [one, one]
    assert [r[2:] for r in one if r[0] in (5, 6)] == [("l00", -2.0)] * 2  # ties of -2 go to the lowest label


def test_pairs_and_confusion_at_any_size(spark, queries, cands):
    scored = [rows_of(SC.pair_scores(queries.drop("label"), cands, lambda c: F.size(c["proto"]), block_bytes=b).drop("vec")) for b in BOUNDS]
    assert scored[0] == scored[1] and len(scored[0]) == 4 * 30 + 2
    pairs = [rows_of(P.entailment_pairs(queries, scope="scope", block_bytes=b)) for b in BOUNDS]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 4 * 2 + 1 + 1
    pred = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", None)], "label string, pred string")
    labels = spark.createDataFrame([(x,) for x in "abcd"], "label string")
    grids = [rows_of(E.confusion(pred, labels, block_bytes=b)) for b in BOUNDS]
    assert grids[0] == grids[1] and len(grids[0]) == 16


def test_no_candidates(queries, cands):
    out = SC.nearest_prototype(queries, cands.limit(0)).collect()
    assert len(out) == 7 and all(r.pred is None for r in out)


def test_broadcast_only_within_the_bound(cands):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(joins.checked_broadcast(cands)) and not hint(joins.checked_broadcast(cands, max_bytes=100))


def test_the_query_side_is_scanned_once(spark):
    from intentloom.registry import QUERIES, load_all
    from tests.conftest import SF_SMALL
    load_all()
    p = QUERIES["j6_nearest_proto"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Join") == 1 and p.count("embeddings.parquet") <= 1 and "LeftAnti" in p


@pytest.mark.parametrize("block_bytes", [None, 2000])
def test_pair_model_in_the_row_equals_the_pair_form(spark, block_bytes):
    import math
    import random
    from intentloom.operators import models as MD
    rnd = random.Random(5)
    d = 6
    weights, intercept = [rnd.uniform(-2, 2) for _ in range(4 * d)], 0.3
    vec = lambda: [float(rnd.choice([0, 0, 1, 2, -1.5])) for _ in range(d)]
    texts = [(i, rnd.choice("st"), "t", vec()) for i in range(60)] + [(60, "s", "t", None), (61, "none", "t", vec()), (62, None, "t", vec()), (5, "s", "u", vec())]
    names = [("s", f"l{i:02d}", vec()) for i in range(40)] + [("s", "twin", [0.0] * d), ("s", "a twin", [0.0] * d), ("t", "only", vec())]

    def sure(a, b):
        x = [*a, *b, *(abs(p - q) for p, q in zip(a, b)), *(p * q for p, q in zip(a, b))]
        return round(1 / (1 + math.exp(-(sum(w * v for w, v in zip(weights, x)) + intercept))), 9)

    want = []
    for uid, scope, label, a in texts:
        scored = sorted((-sure(a or [0.0] * d, b), n) for s, n, b in names if s == scope)
        want.append((uid, label, scored[0][1] if scored else None, -scored[0][0] if scored else None))
    got = MD.best_entailed(spark.createDataFrame(texts, "uid long, scope string, label string, vec array<double>"),
                           spark.createDataFrame(names, "scope string, label string, lvec array<double>"), weights, intercept, carry=("label",), block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_fitted_pair_model_gives_the_same_predictions_without_pairs(spark):
    from intentloom.plans import nli, split_build
    from intentloom.sources import views
    from tests.conftest import SF_SMALL
    sp, _ = split_build.build(views.utt(spark, SF_SMALL), materialized=True)
    best = nli.classifier_scores(sp, "joint", 5).groupBy("uid", "truth").agg(
        F.min_by("label_name", F.struct(-F.round("score", SC.TIE_DIGITS), F.col("label_name"))).alias("pred"))
    rows = nli.classifier_predictions(sp, "joint", 5)
    assert sorted(map(tuple, best.collect())) == sorted((r.uid, r.label, r.pred) for r in rows.collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan.split("Scan")[0]
    report = {r.label: r for r in nli.classifier_report(sp, "joint", 5).collect()}
    assert report["accuracy"].support == rows.count() and report["weighted avg"].f1 > 0
