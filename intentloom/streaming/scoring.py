"""Stream-static scoring: incoming vectors -> nearest class prototype.

Each micro-batch is handed to ``foreachBatch`` and scored with the batch
operator (``score.nearest_prototype``).  Output goes to
``<out>/batch_id=<n>`` with overwrite, so a batch re-run after a failure
replaces its own output and nothing else (exactly-once with the checkpoint).
No state is kept between batches, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.operators import score as SC
from intentloom.operators.joins import candidate_blocks
from intentloom.session import cores, materialize

SLOT_BYTES = 32 << 20  # of a batch's files, per task slot


def score_stream(spark: SparkSession, stream: DataFrame, protos: DataFrame, out_path: str,
                 checkpoint: str, key: str = "uid") -> None:
    """Run ``stream`` (rows with key, label, vec) to completion (availableNow)
    and write ``(key, label, pred, score)`` per batch."""
    protos = materialize(SC.with_scope(protos, "all"), "prototypes")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = SC.with_scope(batch.select(key, "label", "vec"), "all")
        out = SC.nearest_prototype(rows, protos, key=key, carry=("label",)).withColumn("score", F.round("score", 6))
        out.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def parquet_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                   max_files: int = 1, max_bytes: int | None = None) -> DataFrame:
    """A file stream over ``directory`` (new parquet files become batches), or over what ``glob`` matches in it:
    single files, or tables written as folders of files.

    The pattern is part of the path: a filter on file names would pass over every file of a folder.  ``max_bytes``
    (in place of ``max_files``) bounds a batch by the size of its files, so a table of many small files does not
    become as many batches."""
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", max_files) if max_bytes is None else r.option("maxBytesPerTrigger", max_bytes)
    return r.parquet(f"{directory.rstrip('/')}/{{{glob}}}" if glob else directory)


def batch_bytes(spark: SparkSession) -> int:
    """Bytes of files per batch that keep every task slot busy."""
    return cores(spark) * SLOT_BYTES


def running_confusion(spark: SparkSession, stream: DataFrame, protos: DataFrame, out_path: str,
                      checkpoint: str) -> None:
    """Stateful: ``(label, pred, n)`` counts over everything that has arrived.

    Each row is scored against the prototypes, which come in size-checked blocks by
    stream-static broadcast joins (stateless, ties to the lowest label); ``groupBy(label, pred).count()`` keeps its running counts
    in the state store (labels x labels entries, bounded).  Every micro-batch
    rewrites the complete table (idempotent on retry)."""
    rows = stream.select("label", "vec", F.lit(0).alias("__one"))
    for i, block in enumerate(candidate_blocks(protos.select("label", "proto"), ["label", "proto"])):
        rows = rows.join(F.broadcast(block.withColumn("__one", F.lit(0))), "__one")
        found = F.array_min(F.transform("__arr", lambda c: F.struct(F.round(V.l2_dist("vec", c["proto"]), 9).alias("d"),
                                                                    c["label"].alias("label"))))
        rows = rows.withColumn("__best", F.least("__best", found) if i else found).drop("__arr")
    scored = rows.select("label", F.col("__best.label").alias("pred"))
    counts = scored.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (counts.writeStream.outputMode("complete").foreachBatch(handle)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
