"""Hand-computed cases for the hard semantics."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from intentloom.functions import text as T
from intentloom.functions import vectors as V
from intentloom.functions.order import seeded_key
from intentloom.operators import encode as EN
from intentloom.operators import evaluate as E
from intentloom.operators import labels as L
from intentloom.operators import score as SC
from intentloom.operators import split as S
from intentloom.operators.rank import class_rank, global_rank
from intentloom.sources import readers as R


def utts(spark, rows):
    return spark.createDataFrame(rows, "uid long, utterance string, label string, ord long")


def test_dedup_last_label_wins_first_position_kept(spark):
    df = utts(spark, [(1, "x", "a", 1), (2, "y", "c", 2), (3, "x", "b", 3), (4, "x", "a", 4), (5, "z", "b", 5),
                      (6, "z", "c", 6)])
    out = {r.utterance: (r.uid, r.label, r.ord) for r in L.dedup_last_wins(df).collect()}
    assert out == {"x": (1, "a", 1), "y": (2, "c", 2), "z": (5, "c", 5)}


def test_label_taken_over_by_dedup_is_reported(spark):
    df = utts(spark, [(1, "x", "gone", 1), (2, "x", "keep", 2), (3, "y", "keep", 3)])
    roles = spark.createDataFrame([("gone", "seen"), ("keep", "seen")], "label string, role string")
    sp = S.split_sets(L.dedup_last_wins(df), roles, shots=(1,))
    audit = S.split_audit(sp, roles, shots=(1,))
    empty = [r.label for r in audit.where("empty_label").collect()]
    assert empty == ["gone"]


@pytest.mark.parametrize("n,train", [(1, 0), (2, 1), (3, 2), (4, 2), (29, 19), (100, 66)])
def test_train_size_is_exact_integer_division(spark, n, train):
    df = utts(spark, [(i, f"t{i}", "a", i) for i in range(n)])
    parts = S.ratio_split(df).groupBy("part").count().collect()
    got = {r.part: r["count"] for r in parts}
    assert got.get("train", 0) == train and got.get("test", 0) == n - train


def test_support_larger_than_train_part_keeps_all_and_audit_reports(spark):
    df = utts(spark, [(i, f"t{i}", "a", i) for i in range(4)])  # train part = 2
    roles = spark.createDataFrame([("a", "seen")], "label string, role string")
    sp = S.split_sets(df, roles, shots=(1, 5))
    sup5 = sp.where("part = 'support_seen' and k = 5").count()
    assert sup5 == 2
    audit = S.split_audit(sp, roles, shots=(1, 5))
    short = audit.where("part = 'support_seen' and k = 5").first().short
    assert short == 3
    with pytest.raises(ValueError):
        S.split_audit(sp, roles, shots=(1, 5), strict=True)


def test_supports_nest_and_lie_in_train_part(spark):
    df = utts(spark, [(i, f"t{i}", f"l{i % 3}", i) for i in range(90)])
    roles = spark.createDataFrame([("l0", "seen"), ("l1", "seen"), ("l2", "novel")], "label string, role string")
    sp = S.split_sets(df, roles, shots=(1, 5, 10), keep_rank=True)
    rows = sp.collect()
    train_rank = {r.uid: r.rn <= r.train_n for r in rows if r.k == 0 or True}
    by_k = {}
    for r in rows:
        if r.k > 0:
            by_k.setdefault(r.k, set()).add(r.uid)
            assert train_rank[r.uid]
    assert by_k[1] <= by_k[5] <= by_k[10]


def test_tie_goes_to_lowest_label(spark):
    protos = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [-1.0, 0.0])], "label string, proto array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "uid long, vec array<double>")
    out = SC.nearest_prototype(SC.with_scope(q, "all"), SC.with_scope(protos, "all")).first()
    assert out.pred == "a" and math.isclose(out.score, 1.0)


def test_report_with_unpredicted_and_untrue_classes(spark):
    pred = spark.createDataFrame([(1, "a", "a"), (2, "a", "c"), (3, "b", "a"), (4, "b", "a")],
                                 "uid long, label string, pred string")
    rep = {r.label: r for r in E.class_report(pred).collect()}
    assert rep["a"].precision == pytest.approx(1 / 3, abs=1e-6) and rep["a"].recall == 0.5
    assert rep["b"].precision == 0.0 and rep["b"].recall == 0.0 and rep["b"].f1 == 0.0  # never predicted
    assert rep["c"].support == 0 and rep["c"].precision == 0.0  # predicted, never true
    assert rep["accuracy"].f1 == 0.25 and rep["accuracy"].support == 4
    assert rep["macro avg"].recall == pytest.approx((0.5 + 0 + 0) / 3, abs=1e-6)


def test_safe_div_and_masked_softmax_at_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0, [1.0, 2.0], [0, 0])], "n double, d double, a array<double>, m array<int>")
    r = df.select(V.safe_div("n", "d").alias("q"), V.masked_softmax("a", "m").alias("p"),
                  V.cosine(F.array(F.lit(0.0), F.lit(0.0)), "a").alias("c")).first()
    assert r.q == pytest.approx(1e8)
    assert r.p == [0.0, 0.0]
    assert r.c is None


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 1000.0],)], "a array<double>")
    p = df.select(V.softmax("a").alias("p")).first().p
    assert sum(p) == pytest.approx(1.0)


def test_text_edge_cases_are_not_dropped(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, "x  y", "a"), (3, "null", "a"), (4, "t\tu\nv", "a"), (5, None, "a")],
                               "uid long, utterance string, label string")
    kept = sorted(r.uid for r in df.na.drop().collect())
    assert kept == [1, 2, 3, 4]
    n = {r.uid: r.n for r in df.select("uid", T.token_count("utterance").alias("n")).collect()}
    assert n[1] == 1 and n[2] == 3


def test_pair_encode_label_longer_than_budget(spark):
    df = spark.createDataFrame([(list(range(1000, 1010)), list(range(2000, 2070)))], "s array<int>, l array<int>")
    e = df.select(T.pair_encode("s", "l", 64).alias("e")).first().e
    assert e.input_ids[:2] == [101, 102]  # sentence cut to nothing
    assert len(e.input_ids) == 64 and len(e.token_type_ids) == 64 and e.len == 64


def test_tail_encode_keeps_closing_marker(spark):
    df = spark.createDataFrame([(list(range(1, 101)),)], "ids array<int>")
    ids = df.select(T.tail_encode("ids", 10).alias("x")).first().x
    assert ids == [101, 93, 94, 95, 96, 97, 98, 99, 100, 102]


def test_word_vector_caps(spark, tmp_path):
    from intentloom.sources import exporters as X
    from intentloom.sources import readers as R
    wv = spark.createDataFrame([(f"w{i:02d}", [float(i), 1.0]) for i in range(10)], "word string, vec array<float>")
    X.write_word_vectors_json(wv, str(tmp_path / "j"), chunk=3)
    X.write_word2vec_text(wv, str(tmp_path / "t"))
    j = R.read_word_vectors_json(spark, str(tmp_path / "j"), nmax=3).orderBy("word_id").collect()
    t = R.read_word2vec_text(spark, str(tmp_path / "t"), nmax=3).orderBy("word_id").collect()
    assert [r.word for r in j] == ["w00", "w01", "w02", "w03"]
    assert [r.word for r in t] == ["w00", "w01", "w02"]


def test_class_rank_equals_plain_window_under_skew(spark):
    rows = [(i, "hot" if i % 3 else f"c{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "uid long, label string").withColumn("h", seeded_key("uid", salt="t"))
    a = class_rank(df, ["label"], "h", "uid", out="rn", prefix_len=2)
    w = Window.partitionBy("label").orderBy("h", "uid")
    b = df.withColumn("rn2", F.row_number().over(w))
    j = a.join(b.select("uid", "rn2"), "uid")
    assert j.where("rn <> rn2").count() == 0 and j.count() == 3000


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("x")).repartition(13)
    r = global_rank(df, [F.col("x").desc()], out="rn")
    got = sorted((row.rn, row.x) for row in r.collect())
    assert [g[0] for g in got] == list(range(1, 5001))
    assert [g[1] for g in got] == sorted(range(5000), reverse=True)


def test_running_best_bucketed_equals_naive(spark):
    import random
    rnd = random.Random(7)
    vals = [float(rnd.random() < 0.6) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(vals)), "episode long, acc double")
    got = {r.episode: (r.running, r.is_best) for r in E.running_best(df, every=50, bucket=37).collect()}
    best, s = -1.0, 0.0
    for i, v in enumerate(vals):
        s += v
        if i % 50 == 49:
            run = s / (i + 1)
            best = max(best, run)
            assert got[i][0] == pytest.approx(round(run, 6))
            assert got[i][1] == (run >= best)
    assert len(got) == 20


def test_python_encoder_plugin_matches_jvm_hash_encoder(spark):
    from intentloom.operators import encode as EN
    from intentloom.operators import models as MD
    df = spark.createDataFrame([(1, "Hello hello  world"), (2, " a b c "), (3, "Ünïcode Ünïcode x")],
                               "uid long, utterance string")
    py = {r.uid: [float(x) for x in r.vec] for r in MD.encode(df, MD.numpy_hash_encoder(16), dim=16).collect()}
    jvm = {r.uid: list(r.vec) for r in EN.hash_encode(df, 16).collect()}
    assert py == jvm


@pytest.mark.parametrize("max_rows", [1, 200_000])
def test_rank_cuts_equal_plain_window(spark, max_rows):
    from intentloom.operators.rank import rank_cuts
    rows = [(i, "hot" if i % 4 else f"c{i % 5}") for i in range(4000)]
    df = spark.createDataFrame(rows, "uid long, label string").withColumn("h", seeded_key("uid", salt="t"))
    cuts = {"a": lambda n: F.floor(n * 2 / 3).cast("long"), "b": lambda n: F.least(F.lit(5).cast("long"), n),
            "c": lambda n: F.lit(0).cast("long")}
    got = rank_cuts(df, ["label"], "h", "uid", cuts, prefix_len=1, max_bucket_rows=max_rows)
    w = Window.partitionBy("label").orderBy("h", "uid")
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("label")))
    ref = ref.select("uid", (F.col("rn") <= F.floor(F.col("n") * 2 / 3)).alias("ra"), (F.col("rn") <= F.least(F.lit(5), F.col("n"))).alias("rb"))
    j = got.join(ref, "uid")
    assert j.count() == 4000
    assert j.where("a <> ra or b <> rb or c").count() == 0


def test_json_splits_follow_each_other_over_all_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.json").write_text(
            '{"train": [["t%d", "x"], ["u%d", "x"]], "val": [["v%d", "x"]], "test": []}' % (i, i, i))
    r = R.with_ord(R.read_json_pairs(spark, str(tmp_path), multi_line=True), keys=("ord_key",)).orderBy("ord").collect()
    assert [x.utterance for x in r] == ["v0", "v1", "v2", "t0", "u0", "t1", "u1", "t2", "u2"]
    assert r[0].split == "val" and r[-1].split == "train" and [x.ord for x in r] == list(range(9))


def test_word2vec_header_is_told_by_its_place(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 1\na 0.5\n7 2\nb 1\n")
    assert [(r.word, r.vec) for r in R.read_word2vec_text(spark, str(tmp_path)).orderBy("word_id").collect()] == \
        [("a", [0.5]), ("7", [2.0]), ("b", [1.0])]


def test_pooling_keeps_texts_without_known_words(spark):
    u = spark.createDataFrame([(1, "a b"), (2, "zzz"), (3, ""), (4, None)], "uid long, utterance string")
    wv = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vec array<double>")
    toks = EN.tokens(u)
    for out, want in ((EN.pool_max_mean(toks, wv), [1.0, 2.0, 0.5, 1.0]), (EN.piecewise_pool(toks, wv, pieces=2), [1.0, 0.0, 0.0, 2.0]),
                      (EN.weighted_pool(toks, wv, EN.idf_weights(toks, texts=u)), [0.5, 1.0])):
        got = {r.uid: r.pooled for r in out.collect()}
        assert got == {1: pytest.approx(want), 2: None, 3: None, 4: None}


def test_zero_shot_keeps_texts_without_known_words(spark):
    from intentloom.plans import zero_shot
    u = spark.createDataFrame([(1, "a b", "l"), (2, "", "m"), (3, None, "m")], "uid long, utterance string, label string")
    emb = spark.createDataFrame([(0, [1.0, 0.5])], "vec_id long, embedding array<double>")
    got = {r.uid: (r.label, r.pred, r.score) for r in zero_shot.predictions(spark, u, emb).collect()}
    assert got == {1: ("l", "l", 1.0), 2: ("m", "l", -2.0), 3: ("m", "l", -2.0)}


@pytest.mark.parametrize("take", [0, 1, 37, 100, 1000])
def test_keep_smallest_equals_a_plain_sort(spark, take):
    from intentloom.operators.rank import keep_smallest
    df = spark.range(100).select("id", seeded_key("id", salt="k").alias("h"))
    want = sorted((r.h, r.id) for r in df.collect())[:take]
    got = keep_smallest(df, "h", ["id"], F.lit(take), prefix_len=1)
    assert sorted((r.h, r.id) for r in got.collect()) == want and got.columns == df.columns


def test_negatives_from_given_positives_are_the_same(spark):
    from intentloom.operators import pairs as P
    df = spark.createDataFrame([(i, "o", None if i % 11 == 0 else f"l{i % 4}") for i in range(60)], "uid long, origin string, label string")
    pairs = P.entailment_pairs(df)
    one, two = P.sample_negatives(pairs), P.sample_negatives(pairs, positives=P.entailment_positives(df))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(one) == rows(two) and len(rows(one)) == 54 * 3


def test_seen_classifier_learns(spark):
    """M1 over whole languages: held-out accuracy, whatever the text column is called."""
    from intentloom.operators import evaluate as E
    from intentloom.operators import models as MD
    from intentloom.plans import split_build
    from intentloom.sources import views
    from tests.conftest import SF_SMALL
    sp, _ = split_build.build(views.utt_lang(spark, SF_SMALL), m=1, materialized=True)
    train, test = (sp.where(F.col("part") == p).withColumnRenamed("utterance", "words") for p in ("train_seen", "test_seen"))
    got = MD.classify(MD.seen_classifier(train, text="words"), test)
    r = E.accuracy(got).first()
    assert r.n == test.count() > 20 and r.acc > 0.85
