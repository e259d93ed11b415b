"""Corpus pipeline: documents through five stages of the ``llm`` operators.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and returns a
DataFrame; ``run`` writes each stage's result as Parquet below ``spark.checkpoint.dir`` and reads it
back as the next one's documents.  All stages but the last return the columns of documents.

1. language ID: texts without letters, or whose language is uncertain, go.
2. n-gram Jaccard join: one document of each group of near copies stays (the least doc_id, then the least text hash).
3. suffix-array dedup: repeated passages are cut out of the texts; emptied texts go.
4. mixing: texts hold their words as often as the mix takes them; what it does not take goes.
5. packing: the pieces of all documents in sequences of at most 2048 tokens.

Rows without a doc_id or that repeat one are kept apart by their text (its 64-bit hash).  All other columns, whatever their
names, travel in one struct and come out as they went in.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentloom.llm.common import doc_key, stored, table, with_text
from intentloom.llm.jaccard_join import near_duplicates
from intentloom.llm.langid import identify, learn
from intentloom.llm.mixing import mixed_documents
from intentloom.llm.packing import pack
from intentloom.llm.suffix_dedup import suffix_dedup

MIN_SCORE = 0.5  # posterior probability below which a language is uncertain


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by a model of the documents' own labels."""
    judged = identify(docs.select("text", F.struct("*").alias("row")), learn(docs), ["row"])
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id and then by text, of each class of near copies."""
    stay = near_duplicates(docs).filter("first").select(doc_key().alias("doc"), "th").distinct()
    rows = docs.select(doc_key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.struct("*").alias("row"))
    return rows.join(stay, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]).select("row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat an earlier passage of 100 bytes or more."""
    rows = docs.select("doc_id", "text", F.struct(*(f"`{c}`" for c in docs.columns if c != "text")).alias("row"))
    cut = suffix_dedup(rows, carry=["row"], as_text=True).filter((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    return cut.select(*with_text(docs, F.col("kept")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as often as the mix to target weights takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("suffix_array_dedup", suffix_array_dedup),
          ("mixing", mixing), ("packing", packing)]

# fitted models, sampled paths and a tokenizer: tested stage by stage against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
