"""Match kernel, subwords, hot joins, length batches, moments and nested sweep steps against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentloom.operators import encode as EN
from intentloom.operators import evaluate as E
from intentloom.operators import joins
from intentloom.operators import match_kernel as MK
from intentloom.operators import matching as M
from intentloom.operators import models as MD
from intentloom.operators import subwords as SW
from intentloom.operators import sweeps as W


def test_kernel_equals_the_column_expressions(spark):
    rng = np.random.default_rng(2)
    mat = lambda r, d=5: (rng.standard_normal((r, d)) * (rng.random((r, 1)) > 0.2)).round(3).tolist()
    rows = [(i, mat(1 + i % 4), mat(1 + i % 3)) for i in range(40)]
    w = [0.5, 1.0, 0.0, 2.0, 1.5]
    df = spark.createDataFrame(rows, "k long, A array<array<float>>, B array<array<float>>").repartition(3)
    got = {r.k: r for r in MK.match_scores(df, ["k"], {n: (n, w if n in ("maxpool", "headwise") else None) for n in MK.SCORES} | {"soft_w": ("soft_align", w)}).collect()}
    wc = F.array(*map(F.lit, w))
    want = M.with_alignment(df).select("k", M.maxsim("att").alias("maxsim_s"), M.maxsim("attT").alias("maxsim_q"), M.soft_align().alias("soft_align"), M.max_attentive().alias("max_attentive"),
                                       M.maxpool(F.col("A"), F.col("B"), wc).alias("maxpool"), M.soft_align(w=wc).alias("soft_w")).collect()
    for r in want:
        for c in r.asDict():
            assert got[r.k][c] == pytest.approx(r[c], abs=1e-9)
    odd = spark.createDataFrame([(1, None, mat(2)), (2, [], mat(2)), (3, mat(2), mat(3, 4)), (4, mat(2), mat(3))], "k long, A array<array<float>>, B array<array<float>>")
    got = {r.k: (r.m, r.h) for r in MK.match_scores(odd, ["k"], {"m": ("maxsim_s", None), "h": ("headwise", None)}).collect()}
    assert got[1] == got[2] == got[3] == (None, None) and got[4][0] is not None and got[4][1] is None


def test_greedy_subwords(spark):
    pieces = {p: 10 + i for i, p in enumerate(["un", "u", "believ", "##able", "##a", "##b", "##believ", "##ab", "x", "##x", "é", "##漢"])}

    def plain(word):
        out, at = [], 0
        while at < len(word):
            hit = next((n for n in range(len(word), at, -1) if ("##" if at else "") + word[at:n] in pieces), None)
            if hit is None or len(word) > 100:
                return [100]
            out.append(pieces[("##" if at else "") + word[at:hit]])
            at = hit
        return out

    texts = [(1, "unbelievable uab x"), (2, "xx" * 60 + " un"), (3, ""), (4, None), (5, "é漢漢 q uab unq"), (6, " x  " + "x " * 300)]
    df = spark.createDataFrame(texts, "uid long, utterance string")
    vocab = spark.createDataFrame(list(pieces.items()), "piece string, piece_id int")
    for bound in (None, 0):
        got = {r.uid: r.ids for r in SW.subword_ids(EN.tokens(df), vocab, max_bytes=bound).collect()}
        assert got == {i: [p for w in (t or "").split(" ") if w for p in plain(w)] for i, t in texts}
    assert SW.subword_ids(EN.tokens(df), vocab.limit(0)).where("uid = 1").first().ids == [100] * 3


def test_subwords_are_cut_in_place(spark):
    """A small vocabulary: one shuffle of runs, no join of words; rows in any order and repeated keys give the rows of the table form."""
    vocab = spark.createDataFrame([("a", 1), ("##b", 2), ("##bb", 3), ("c", 4), ("c", 5)], "piece string, piece_id int")
    long = " ".join(["abbb", "c", "", "q"] * 6000)  # more than an Arrow batch
    toks = EN.tokens(spark.createDataFrame([(1, "abb c"), (1, "c ab zz"), (2, long), (None, "ab"), (3, "a" * 101)], "uid long, utterance string"))
    lost = spark.createDataFrame([(2, 30000, None), (4, 0, None)], "uid long, pos int, token string")
    toks = toks.unionByName(lost)
    got = [{r.uid: r.ids for r in SW.subword_ids(t, vocab, max_bytes=bound).collect()} for t, bound in
           ((toks, None), (toks, 0), (toks.repartition(5).sortWithinPartitions(F.xxhash64("pos", "uid")), None))]
    assert got[0] == got[1] == got[2]
    assert got[0] == {1: [1, 3, 5, 1, 2, 5, 100], 2: [1, 3, 2, 5, 100] * 6000, 3: [100], 4: [], None: [1, 2]}
    plan = SW.subword_ids(toks, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_hot_join_above_the_bound(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["the", "the", f"w{rnd.randrange(400)}", "lost", None])) for i in range(9000)]
    table = [("the", 1)] + [(f"w{i}", i + 2) for i in range(0, 400, 2)]
    df, t = spark.createDataFrame(rows, "i long, token string").repartition(4), spark.createDataFrame(table, "token string, word_id int")
    key = dict(table)
    want = sorted(((i, w, key.get(w)) for i, w in rows), key=repr)
    for bound in (None, 0):
        got = joins.hot_join(df, t, "token", max_bytes=bound)
        assert sorted(((r.i, r.token, r.word_id) for r in got.collect()), key=repr) == want
        inner = joins.hot_join(df, t, "token", "inner", max_bytes=bound)
        assert sorted(((r.i, r.token, r.word_id) for r in inner.collect()), key=repr) == [x for x in want if x[2] is not None]
    # hot rows do not meet in one task
    placed = joins.hot_join(df, t, "token", max_bytes=0).where("token = 'the'").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) > 1
    toks = EN.tokens(spark.createDataFrame([(1, "the w2 lost the"), (2, "w0")], "uid long, utterance string"))
    vocab = t.withColumnRenamed("token", "word")
    assert sorted(map(tuple, EN.token_ids(toks, vocab, max_bytes=0).collect())) == sorted(map(tuple, EN.token_ids(toks, vocab).collect()))


def test_length_batches(spark):
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 5, 80])))) for i in range(500)] + [(900, None), (901, "x " * 5000)]
    df = spark.createDataFrame(texts, "uid long, utterance string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = MD.encode_by_length(df, MD.numpy_hash_encoder(8), 8, budget=400).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = {r.uid: r.vec for r in MD.encode(df, MD.numpy_hash_encoder(8), 8).collect()}
    assert {r.uid: r.vec for r in got} == plain and len(got) == 502
    assert all(r.batch_rows == 1 or r.batch_rows * r.batch_width <= 400 for r in got) and max(r.batch_rows for r in got) > 20
    share = MD.padding_share(MD.encode_by_length(df, MD.numpy_hash_encoder(8), 8, budget=400)).first()
    assert share.n_rows == 502 and 0 <= share.padding < 0.25


def test_moments_merge(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), i % 7, 1e6 + rnd.random()) for i in range(700)] + [(None, 0, 5.0)]
    df = spark.createDataFrame(rows, "run string, part int, v double")
    parts = E.moments(df, "v", ["run", "part"])
    for r in E.finish_moments(E.merge_moments(parts, ["run"]), ["run"]).collect():
        v = [x for run, _, x in rows if run == r.run]
        assert (r["mean"], r["count"]) == (pytest.approx(statistics.fmean(v), abs=1e-5), len(v)) and r["std"] == pytest.approx(statistics.pstdev(v), abs=1e-5)
    r = E.finish_moments(E.merge_moments(parts)).first()
    assert r["count"] == 701 and r["std"] == pytest.approx(statistics.pstdev([x for *_, x in rows]), abs=1e-3)


def test_step_prototypes(spark):
    rows = [(lab, i, [float(i * 3 % 7), float(i)]) for lab, n in (("a", 12), ("b", 3), ("c", 1)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "label string, rn long, vec array<double>")
    got = {(r.step, r.label): (r.n_support, r.proto) for r in W.step_prototypes(df, [(1, 1), (5, 5), (10, 10)]).collect()}
    for k in (1, 5, 10):
        for lab in "abc":
            v = [x for name, i, x in rows if name == lab and i <= k]
            assert got[k, lab] == (len(v), pytest.approx(np.mean(v, axis=0).tolist()))
    assert len(got) == 9


def test_fitting_reads_written_vectors(spark, monkeypatch):
    """M2: the training table and the vectors are written once; no pass of the fit splits texts or draws pairs again."""
    from intentloom.operators import models as MD
    from intentloom.plans import nli, split_build
    rows = [(i, f"{'abc'[i % 3]} word{i} {'abc'[i % 3]}x", f"l{i % 3}", i) for i in range(60)]
    sp, _ = split_build.build(spark.createDataFrame(rows, "uid long, utterance string, label string, ord long"), materialized=True)
    seen, fit = [], MD.pair_classifier
    monkeypatch.setattr(MD, "pair_classifier", lambda f: seen.append(f) or fit(f))
    qv = nli._fitted(sp, "joint", 5, 8)[1]
    for df in (seen[0], qv):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "HashAggregate" not in plan
    assert nli.classifier_report(sp, "joint", 5).count() == 6


def test_pair_scores_of_the_fitted_model_are_whole(spark):
    from intentloom.plans import nli, split_build
    rows = [(i, f"{'abc'[i % 3]} word{i}", f"l{i % 3}", i) for i in range(60)]
    sp, _ = split_build.build(spark.createDataFrame(rows, "uid long, utterance string, label string, ord long"), materialized=True)
    scores = nli.classifier_scores(sp, "joint", 5, 8)
    n = sp.where(F.col("part").isin("test_seen", "test_novel")).count()
    assert scores.count() == 3 * n and scores.where(F.col("score").between(0, 1)).count() == 3 * n
    # no text is split between the written vectors and the pairs
    assert "split(" not in scores._jdf.queryExecution().executedPlan().toString()


def test_hash_encode_counts_words_in_place(spark, monkeypatch):
    """No row per word; texts that share a key (null too) are added, whatever the slices a batch is cut into."""
    import hashlib

    import pyarrow as pa
    from intentloom.operators import encode as EN
    rows = [(1, "A b  a\tc "), (1, " \n b c\x0b"), (2, None), (None, "x y"), (None, "x \u00c4 \u00e4\u00d6"), (3, ""), (4, "   "), (5, "a\x85 b")]
    df = spark.createDataFrame(rows, "uid long, utterance string").repartition(3)
    want = {k: [0] * 8 for k, _ in rows}
    for k, t in rows:
        for w in (t or "").lower().strip(" \t\n\x0b\f\r").split(" "):
            if w:
                want[k][int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
    enc, long = EN.hash_encode(df, 8), EN.hash_encode(df, 8, long_form=True)
    assert "Generate" not in enc._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.uid), r.vec) for r in enc.collect()) == sorted((str(k), v) for k, v in want.items())
    assert sorted((str(r.uid), r.dim, r.value) for r in long.collect()) == sorted((str(k), i, n) for k, v in want.items() for i, n in enumerate(v) if n)

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([t and t.lower() for _, t in rows])], ["k", "t"])
    whole = pa.Table.from_batches(EN._bucket_counts(8, ["k", "n"])([batch]))
    monkeypatch.setattr(EN, "SLICE_BYTES", 4)
    cut = list(EN._bucket_counts(8, ["k", "n"])([batch, batch.slice(0, 0)]))
    assert len(cut) > 2 and pa.Table.from_batches(cut).to_pylist() == whole.to_pylist()
