"""Property tests over generated label distributions (few examples: each is a Spark job)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intentloom.operators import evaluate as E
from intentloom.operators import split as S

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

sizes = st.lists(st.integers(min_value=1, max_value=40), min_size=1, max_size=6)


def make(spark, class_sizes):
    rows, uid = [], 0
    for c, n in enumerate(class_sizes):
        for _ in range(n):
            rows.append((uid, f"text {uid}", f"c{c}", uid))
            uid += 1
    return spark.createDataFrame(rows, "uid long, utterance string, label string, ord long")


@SETTINGS
@given(sizes)
def test_parts_are_disjoint_and_complete_for_seen_classes(spark, class_sizes):
    df = make(spark, class_sizes)
    roles = df.select("label").distinct().withColumn("role", F.lit("seen"))
    sp = S.split_sets(df, roles, shots=(1, 5)).where("k = 0")
    got = sp.groupBy("uid").count()
    assert got.where("count > 1").count() == 0
    assert got.count() == sum(class_sizes)


@SETTINGS
@given(sizes, st.integers(min_value=1, max_value=7))
def test_split_is_the_same_on_any_partitioning(spark, class_sizes, parts):
    df = make(spark, class_sizes)
    roles = df.select("label").distinct().withColumn("role", F.lit("seen"))
    a = sorted(map(tuple, S.split_sets(df, roles).select("uid", "part", "k").collect()))
    b = sorted(map(tuple, S.split_sets(df.repartition(parts), roles).select("uid", "part", "k").collect()))
    assert a == b


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_confusion_sums_to_rows_and_accuracy_is_trace(spark, pairs):
    df = spark.createDataFrame([(i, f"l{a}", f"l{b}") for i, (a, b) in enumerate(pairs)],
                               "uid long, label string, pred string")
    conf = E.confusion(df).collect()
    assert sum(r.n for r in conf) == len(pairs)
    trace = sum(r.n for r in conf if r.label == r.pred)
    acc = [r for r in E.class_report(df).collect() if r.label == "accuracy"][0].f1
    assert abs(acc - round(trace / len(pairs), 6)) < 1e-9
