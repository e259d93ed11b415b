"""Writers of the reference's file layouts (for exports and round trips).

Nothing is funnelled through one task: JSON layouts whose reference form is a
single document are written as many documents (one per chunk of rows, one per
line), which the readers accept as well as the single-file form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions.order import hash_int
from intentloom.operators.rank import global_rank

CSV_OPTS = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# lossless: blanks at the ends stay, quotes are doubled, tabs and newlines are quoted
TSV_OPTS = {"sep": "\t", "header": False, **CSV_OPTS}


def write_tsv(df: DataFrame, path: str, order: str | None = None) -> None:
    """S1 layout: label TAB utterance, no header (rows in ``order`` if given)."""
    d = df.orderBy(order) if order else df
    d.select("label", "utterance").write.mode("overwrite").options(**TSV_OPTS).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """S2 layout: raw ``label\\tutterance`` lines, no quoting."""
    df.select(F.concat_ws("\t", "label", "utterance").alias("value")).write.mode("overwrite").text(path)


def write_csv_header(df: DataFrame, path: str, text_col: str = "text", label_col: str = "category") -> None:
    """S3 layout: CSV with a header, columns ``text_col`` and ``label_col``."""
    w = df.select(F.col("utterance").alias(text_col), F.col("label").alias(label_col)).write.mode("overwrite")
    for k, v in CSV_OPTS.items():
        w = w.option(k, v)
    w.option("header", True).csv(path)


def chunk_of(df: DataFrame, key: str, rows_per_chunk: int):
    """A stable chunk id with about ``rows_per_chunk`` rows per chunk: the
    number of chunks grows with the table (row count as a scalar subquery)."""
    n = df.select(F.count(F.lit(1))).scalar()
    chunks = F.greatest(F.ceil(n.cast("double") / F.lit(float(rows_per_chunk))), F.lit(1))
    return F.pmod(F.xxhash64(F.col(key).cast("string")), chunks)


def write_json_pairs(df: DataFrame, path: str, rows_per_chunk: int = 10_000, key: str = "uid",
                     splits=("val", "test", "train"), order: str | None = None) -> None:
    """S4 layout: objects ``{val: [[utt, label]...], test: [...], train: [...]}``,
    one per chunk of about ``rows_per_chunk`` rows; a row's split and (without
    ``order``) chunk come from stable hashes.  With ``order`` each split's lists read back in that order."""
    x = df.withColumn("__no", (hash_int(key) % len(splits)).cast("int"))
    if order is None:
        x = x.withColumn("__r", F.lit(0).cast("long")).withColumn("__chunk", chunk_of(df, key, rows_per_chunk))
    else:
        x = global_rank(x.withColumn("__o", F.col(order)), [F.col("__no"), F.col("__o")], out="__r")
        x = x.withColumn("__chunk", F.floor((F.col("__r") - 1) / F.lit(rows_per_chunk)))
    entry = F.struct("__r", F.array("utterance", "label").alias("p"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("__no") == i, entry))), lambda e: e["p"]).alias(s) for i, s in enumerate(splits)]
    g = x.groupBy("__chunk").agg(*lists)
    (g if order is None else g.orderBy("__chunk")).drop("__chunk").write.mode("overwrite").json(path)


def write_json_examples(df: DataFrame, path: str, rows_per_chunk: int = 10_000, key: str = "uid",
                        order: str | None = None) -> None:
    """S5 layout: ``{rasa_nlu_data: {common_examples: [{text, intent}]}}`` per chunk.

    With ``order`` the chunks are consecutive ranges of that order and the
    examples keep it, so the files read back in that order."""
    ex = F.struct(F.col("utterance").alias("text"), F.col("label").alias("intent"))
    if order is None:
        x = df.withColumn("__chunk", chunk_of(df, key, rows_per_chunk))
        g = x.groupBy("__chunk").agg(F.collect_list(ex).alias("ex"))
    else:
        r = global_rank(df.withColumn("__o", F.col(order)), [F.col("__o")], out="__r")
        x = r.withColumn("__chunk", F.floor((F.col("__r") - 1) / F.lit(rows_per_chunk)))
        g = (x.groupBy("__chunk").agg(F.array_sort(F.collect_list(F.struct("__r", ex.alias("e")))).alias("__a"))
             .select("__chunk", F.transform("__a", lambda s: s["e"]).alias("ex")).orderBy("__chunk"))
    g.select(F.struct(F.col("ex").alias("common_examples")).alias("rasa_nlu_data")).write.mode("overwrite").json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON document per file, over many lines (the reference's form): ``docs(chunk, doc)``, ``doc`` a struct or an array."""
    text = F.to_json("doc", {"pretty": "true"})
    docs.select("chunk", text.alias("value")).write.mode("overwrite").partitionBy("chunk").text(path)


def write_label_list(labels: DataFrame, path: str) -> None:
    """S6 layout: one label per line."""
    labels.select(F.col("label").alias("value")).write.mode("overwrite").text(path)


def write_word_vectors_json(wv: DataFrame, path: str, order: str = "word", chunk: int = 50) -> None:
    """S7 layout: JSON arrays of ``{word, vec}``; each line holds ``chunk``
    consecutive words of the ``order``, lines and files in that order."""
    r = global_rank(wv.select("word", "vec", F.col(order).alias("__o")), [F.col("__o")], out="__r")
    g = (r.withColumn("__c", F.floor((F.col("__r") - 1) / F.lit(chunk)))
         .groupBy("__c").agg(F.array_sort(F.collect_list(F.struct("__r", "word", "vec"))).alias("__a")))
    lines = g.select("__c", F.to_json(F.transform("__a", lambda s: F.struct(s["word"].alias("word"),
                                                                             s["vec"].alias("vec")))).alias("value"))
    lines.orderBy("__c").select("value").write.mode("overwrite").text(path)


def write_word2vec_text(wv: DataFrame, path: str, order: str = "word") -> None:
    """S8 layout: ``count dim`` header, then ``word v1 ... vd`` lines in order."""
    n = wv.select(F.count(F.lit(1))).scalar()
    dim = wv.select(F.max(F.size("vec"))).scalar()
    body = wv.select(F.col(order).alias("__o"), F.concat_ws(" ", "word", F.array_join(
        F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"), F.lit(1).alias("__h"))
    head = wv.sparkSession.range(1).select(F.lit(None).cast(wv.schema[order].dataType).alias("__o"),
                                           F.concat_ws(" ", n.cast("string"), dim.cast("string")).alias("value"),
                                           F.lit(0).alias("__h"))
    head.unionByName(body).orderBy("__h", "__o").select("value").write.mode("overwrite").text(path)
