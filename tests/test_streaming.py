"""Running confusion counts accumulate across micro-batches in the state store."""

from pyspark.sql import functions as F

from intentloom.operators import evaluate as E
from intentloom.plans import proto_eval
from intentloom.sources import views
from intentloom.streaming import scoring
from tests.conftest import SF_SMALL


def test_running_confusion_over_three_batches(spark, tmp_path):
    emb = views.table(spark, SF_SMALL, "embeddings")
    src = tmp_path / "in"
    for part in range(3):  # three files -> three micro-batches
        emb.where(F.col("vec_id") % 3 == part).coalesce(1).write.parquet(str(src / f"p{part}"))
    protos = proto_eval.prototypes_of(proto_eval.support_of(views.vec(spark, SF_SMALL), 5))
    raw = (spark.readStream.schema(emb.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", True).parquet(str(src)))
    stream = raw.select(F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))
    out = str(tmp_path / "out")
    scoring.running_confusion(spark, stream, protos, out, str(tmp_path / "ckpt"))
    got = {(r.label, r.pred): r.n for r in spark.read.parquet(out).collect()}
    # batch answer over the same rows
    v = views.vec(spark, SF_SMALL)
    best = proto_eval.score.nearest_prototype(proto_eval.score.with_scope(v, "all"),
                                              proto_eval.score.with_scope(protos, "all"))
    ref = E.pair_counts(v.select("uid", "label").join(best, "uid"))
    want = {(r.label, r.pred): r.n for r in ref.collect()}
    assert got == want and sum(got.values()) == emb.count()


def test_stream_reads_a_table_in_a_folder_of_files(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
                                  (F.col("id") % 2).cast("int").alias("label"))
    protos = spark.createDataFrame([("0", [0.0, 1.0]), ("1", [39.0, 1.0])], "label string, proto array<double>")
    folder, single = str(tmp_path / "folder"), str(tmp_path / "single")
    rows.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "single").mkdir()
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "single" / "embeddings.parquet")
    rows.limit(1).write.parquet(f"{folder}/embeddings.parquet.old")  # another table

    def stream(d, **bound):
        raw = scoring.parquet_stream(spark, d, rows.schema, glob="embeddings.parquet", **bound)
        return raw.select(F.col("vec_id").alias("uid"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))

    for i, (d, bound, batches) in enumerate([(folder, {}, 3), (folder, {"max_bytes": 1 << 20}, 1), (single, {}, 1)]):
        out, counts = str(tmp_path / f"out{i}"), str(tmp_path / f"counts{i}")
        scoring.score_stream(spark, stream(d, **bound), protos, out, str(tmp_path / f"a{i}"))
        got = spark.read.parquet(out)
        assert sorted((r.uid, r.pred) for r in got.collect()) == [(u, "0" if u < 20 else "1") for u in range(40)]
        assert got.select("batch_id").distinct().count() == batches
        scoring.running_confusion(spark, stream(d, **bound), protos, counts, str(tmp_path / f"b{i}"))
        assert {(r.label, r.pred): r.n for r in spark.read.parquet(counts).collect()} == {(a, b): 10 for a in "01" for b in "01"}


def test_stream_query_over_a_folder_of_files(spark, tmp_path):
    from intentloom.registry.q_streaming import st_stream_nearest
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
                                  (F.col("id") >= 30).cast("int").alias("label"))
    rows.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = st_stream_nearest(spark, str(tmp_path))
    assert sorted(r.uid for r in got.collect()) == list(range(60)) and got.columns == ["uid", "label", "pred", "score"]
    assert got.where("uid in (0, 59) and label = pred").count() == 2
