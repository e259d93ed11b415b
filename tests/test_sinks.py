"""Sinks and text layouts: a full rewrite clears the target, nothing is lost in a round trip."""

import pytest

from intentloom.operators.evaluate import log_loss, log_loss_known
from intentloom.session import shared_dir
from intentloom.sources.exporters import write_tsv
from intentloom.sources.readers import read_tsv
from intentloom.sources.sinks import read_split, write_split


def split(spark, ks):
    return spark.createDataFrame([(i, "a", f"t{i}", "support_seen", k) for i in range(3) for k in ks],
                                 "uid long, label string, utterance string, part string, k int")


def test_rewrite_clears_the_target(spark):
    path = shared_dir(spark, "clear")
    write_split(split(spark, [1, 5]), path)
    write_split(split(spark, [5]), path)  # replaces its own partitions only
    assert {r.k for r in read_split(spark, path).collect()} == {1, 5}
    write_split(split(spark, [5]), path, dynamic=False)
    assert {r.k for r in read_split(spark, path).collect()} == {5}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_tsv_round_trip_is_lossless(spark):
    texts = ["  lead and trail  ", "x\ny", "tab\there", 'a "quoted" word', "null", "back\\slash", "é日"]
    df = spark.createDataFrame([(f"l{i}", t) for i, t in enumerate(texts)], "label string, utterance string")
    path = shared_dir(spark, "tsv")
    write_tsv(df, path)
    back = {r.label: r.utterance for r in read_tsv(spark, path, multi_line=True).collect()}
    assert back == {f"l{i}": t for i, t in enumerate(texts)}


def test_log_loss_keeps_its_worst_rows(spark):
    df = spark.createDataFrame([(1, "a", "a", 0.5), (1, "b", "a", 0.5), (2, "a", "a", 0.0), (2, "b", "a", 1.0), (3, "b", "z", 1.0)],
                               "uid long, label string, truth string, prob double")
    assert log_loss(df).first().log_loss > 300
    r = log_loss_known(df).first()
    assert (r.n, r.n_unknown) == (2, 1) and r.log_loss == pytest.approx((0.693147 + 708.396419) / 2, abs=1e-5)
