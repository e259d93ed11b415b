"""Physical-plan checks: the plans we rely on for scale."""

from intentloom.registry import QUERIES, load_all
from tests.conftest import SF_SMALL

load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_kshot_uses_partial_window_group_limit(spark):
    p = plan(QUERIES["w5_kshot_support"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_scoring_and_pairs_have_no_nested_loop_or_cartesian(spark):
    for name in ("j1_entail_pairs", "j6_nearest_proto", "j7_zero_shot_cosine", "p2_pair_scoring",
                 "w19_label_ranking", "e1_class_report", "a13_neg_sample"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "BroadcastNestedLoopJoin" not in p, name
        assert "CartesianProduct" not in p, name


def test_split_ranks_by_class_and_bucket(spark):
    # every class is ranked in (class, hash bucket) windows, never one window per class
    df = QUERIES["s10_split_parts"](spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "__cr_b" in p and "BroadcastHashJoin" in p


def test_negative_sampling_ranks_only_boundary_pairs(spark):
    df = QUERIES["a13_neg_sample"](spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "__b1" in p and "Union" in p


def test_projection_prunes_parquet_columns(spark):
    df = QUERIES["a2_dedup_last_wins"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in p and "lang" not in p


def test_filters_reach_the_scan(spark):
    df = QUERIES["f2_label_filter"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
