"""Proof for stream-static scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.plans import proto_eval
from intentloom.registry import query
from intentloom.registry.sqlparts import NEAREST, PROTOS, SUPPORT, VEC
from intentloom.session import shared_dir
from intentloom.sources import views
from intentloom.streaming import scoring


@query("st_stream_nearest", sql=NEAREST.format(queries=VEC, protos=PROTOS(SUPPORT(VEC, 5))))
def st_stream_nearest(spark, d):
    static = views.table(spark, d, "embeddings")
    protos = proto_eval.prototypes_of(proto_eval.support_of(views.vec(spark, d), 5))
    raw = scoring.parquet_stream(spark, d, static.schema, glob="embeddings.parquet", max_bytes=scoring.batch_bytes(spark))
    stream = raw.select(F.col("vec_id").alias("uid"), F.col("label").cast("string").alias("label"),
                        F.col("embedding").alias("vec"))
    out = shared_dir(spark, "stream-out")
    scoring.score_stream(spark, stream, protos, out, shared_dir(spark, "stream-ckpt"))
    return spark.read.parquet(out).select("uid", "label", "pred", "score")


@query("st_running_confusion", sql=f"""
select label, pred, count(*) as n from ({NEAREST.format(queries=VEC, protos=PROTOS(SUPPORT(VEC, 5)))}) group by all
""")
def st_running_confusion(spark, d):
    static = views.table(spark, d, "embeddings")
    protos = proto_eval.prototypes_of(proto_eval.support_of(views.vec(spark, d), 5))
    raw = scoring.parquet_stream(spark, d, static.schema, glob="embeddings.parquet", max_bytes=scoring.batch_bytes(spark))
    stream = raw.select(F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))
    out = shared_dir(spark, "stream-confusion")
    scoring.running_confusion(spark, stream, protos, out, shared_dir(spark, "stream-confusion-ckpt"))
    return spark.read.parquet(out).select("label", "pred", "n")
