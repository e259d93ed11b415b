"""Readers of the reference's file layouts into canonical utterances.

Every reader declares its schema (no inference pass over the data) and can add
the arrival order ``ord`` the reference keeps implicitly: file path, split
offset and the row's position inside its read split, which together sort rows
in file order.  Plain ``ord`` numbering (``with_ord``) is a distributed rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentloom.functions.text import strip
from intentloom.operators.rank import global_rank
from intentloom.session import materialize
from intentloom.sources import splits as SP

JSON_SPLIT_ORDER = ("val", "test", "train")


def arrival_key(df: DataFrame) -> DataFrame:
    """Add ``__file``, ``__block`` and ``__row``: sorting by them gives file order.

    Must be called directly on a file scan (``_metadata`` is the scan's hidden
    column; ``monotonically_increasing_id`` counts rows of a read split in order).
    """
    return (df.withColumn("__file", F.col("_metadata.file_path"))
            .withColumn("__block", F.col("_metadata.file_block_start"))
            .withColumn("__row", F.monotonically_increasing_id()))


def with_ord(df: DataFrame, keys=("__file", "__block", "__row"), out: str = "ord") -> DataFrame:
    """0-based ``ord`` in the order of ``keys`` (distributed total order)."""
    r = global_rank(df, [F.col(k) for k in keys], out=out)
    return r.withColumn(out, F.col(out) - 1).drop(*[k for k in keys if k.startswith("__")])


def read_tsv(spark: SparkSession, path: str, ordered: bool = False, multi_line: bool = False) -> DataFrame:
    """Headerless TSV, label then utterance (quotes honoured, as pandas; empty cells are null).

    ``multi_line`` reads quoted newlines back, at the price of one task per file.
    """
    df = (spark.read.schema("label STRING, utterance STRING").option("sep", "\t")
          .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("multiLine", multi_line).option("header", False).csv(path))
    return with_ord(arrival_key(df)) if ordered else df


def read_lines(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Raw lines, stripped, split on tab with no quote rules; the first
    field is the label, the second the utterance."""
    raw = spark.read.text(path)
    if ordered:
        raw = arrival_key(raw)
    parts = F.split(strip(F.col("value")), "\t")
    df = raw.withColumn("label", F.element_at(parts, 1)).withColumn("utterance", F.element_at(parts, 2)).drop("value")
    return with_ord(df) if ordered else df


def read_csv_header(spark: SparkSession, path: str, text_col: str = "text", label_col: str = "category",
                    ordered: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV with a header row; project the named text and label columns
    (``text``/``category``, or ``"1"``/``"0"`` for the custom layout).  ``multi_line`` reads newlines inside
    quotes: records are found across the splits of a file (``sources.splits``), so large files are many tasks either way."""
    df = keyed_csv(spark, path, text_col, label_col, multi_line)
    return with_ord(df) if ordered else df.select("label", "utterance")


CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def keyed_csv(spark: SparkSession, path: str, text_col: str, label_col: str, multi_line: bool) -> DataFrame:
    """``read_csv_header`` with the columns of ``arrival_key``."""
    if multi_line:
        r = SP.csv_records(spark, path).where("__gid > 0").where(F.trim("record") != "")  # a file's first record is its header
        schema = ", ".join(f"`{c}` STRING" for c in _header(spark, path))
        df = r.select("__file", F.lit(0).cast("long").alias("__block"), F.col("__gid").alias("__row"), F.from_csv("record", F.lit(schema), CSV).alias("__r"))
        df = df.select("__file", "__block", "__row", "__r.*")
    else:
        df = arrival_key(spark.read.option("header", True).options(**CSV).csv(path))
    return df.select(F.col(f"`{label_col}`").alias("label"), F.col(f"`{text_col}`").alias("utterance"), "__file", "__block", "__row")


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**CSV).option("header", True).csv(path).columns


class MalformedRows(ValueError):
    """A strict read met rows that do not fit the layout."""


def _parted(r: DataFrame, bad, strict: bool) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` of a table written once; strict: an error that names the number and the first of the rejects."""
    r = materialize(r, "checked")
    rejects = r.where(bad)
    if strict and (n := rejects.count()):
        raise MalformedRows(f"{n} malformed rows, such as {rejects.orderBy('file', 'record_no').first()}")
    return r.where(~bad), rejects


def read_tsv_checked(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S1 with a quarantine: ``(rows, rejects)``.  A row with more than two fields, at which the usual parsers stop, or with a
    quote that nothing closes, is no row but a reject ``(file, record_no, record, n_fields)``; fewer fields leave nulls.
    ``strict`` raises ``MalformedRows`` instead."""
    r = SP.csv_records(spark, path, "\t").where(F.trim("record") != "")
    r = r.select(F.col("__file").alias("file"), F.col("__gid").alias("record_no"), "record", SP.field_count(F.col("record"), "\t").alias("n_fields"),
                 SP.left_open(F.col("record"), "\t").alias("open"))
    good, rejects = _parted(r, (F.col("n_fields") > 2) | F.col("open"), strict)
    row = F.from_csv("record", F.lit("label STRING, utterance STRING"), {**CSV, "sep": "\t"})
    return good.select(row.alias("r")).select("r.*"), rejects.drop("open")


def read_csv_checked(spark: SparkSession, path: str, text_col: str = "text", label_col: str = "category", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3 with a quarantine, as ``read_tsv_checked``; a row may have as many fields as the header."""
    names = _header(spark, path)
    r = SP.csv_records(spark, path).where("__gid > 0").where(F.trim("record") != "")
    r = r.select(F.col("__file").alias("file"), F.col("__gid").alias("record_no"), "record", SP.field_count(F.col("record"), ",").alias("n_fields"),
                 SP.left_open(F.col("record"), ",").alias("open"))
    good, rejects = _parted(r, (F.col("n_fields") > len(names)) | F.col("open"), strict)
    row = F.from_csv("record", F.lit(", ".join(f"`{c}` STRING" for c in names)), CSV)
    return good.select(row.alias("r")).select(F.col("r")[label_col].alias("label"), F.col("r")[text_col].alias("utterance")), rejects.drop("open")


def read_json_checked(spark: SparkSession, path: str, schema: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S4, S5 (one document per line) with a quarantine: ``(documents, rejects)``, the rejects being lines that are no JSON of
    ``schema``: ``(file, record_no, record)``."""
    df = arrival_key(spark.read.schema(schema + ", __bad STRING").option("columnNameOfCorruptRecord", "__bad").json(path))
    df = df.select(F.col("__file").alias("file"), F.struct("__block", "__row").alias("record_no"), F.col("__bad").alias("record"), *(c for c in df.columns if not c.startswith("__")))
    good, rejects = _parted(df, F.col("record").isNotNull(), strict)
    return good.drop("file", "record_no", "record"), rejects.select("file", "record_no", "record")


def read_json_pairs(spark: SparkSession, path: str, splits=JSON_SPLIT_ORDER, multi_line: bool = False) -> DataFrame:
    """JSON objects ``{split: [[utterance, label], ...]}``; rows of all
    splits in the given split order over the whole input, each list in its own order.

    Adds ``split`` and an ``ord_key`` struct (split order, file order, list
    position); rank it with ``with_ord`` if dense numbers are needed.  One scan: the
    lists are exploded from one array, tagged with their split.  ``multi_line``: each file
    is one document, of any size, read by many tasks (``sources.splits``).
    """
    if multi_line:
        e = SP.json_elements(spark, path, 2, "[").where(F.col("list").isin(*splits)).withColumn("__pair", F.from_json("element", "array<string>"))
        no = F.array_position(F.lit(list(splits)), F.col("list")).cast("int") - 1
        return e.select(F.get("__pair", F.lit(1)).alias("label"), F.get("__pair", F.lit(0)).alias("utterance"), F.col("list").alias("split"),
                        F.struct(no.alias("__split_no"), "__file", F.lit(0).cast("long").alias("__block"), F.col("__gid").alias("__row"), F.lit(0).alias("__pos")).alias("ord_key"))
    schema = ", ".join(f"{s} ARRAY<ARRAY<STRING>>" for s in splits)
    df = arrival_key(spark.read.schema(schema).json(path))
    lists = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(s).alias("split"), F.col(s).alias("pairs")) for i, s in enumerate(splits)])
    x = df.select("__file", "__block", "__row", F.explode(lists).alias("__l"))
    x = x.select("__file", "__block", "__row", F.col("__l.no").alias("__split_no"), F.col("__l.split").alias("split"),
                 F.posexplode("__l.pairs").alias("__pos", "__pair")).where(F.col("__pair").isNotNull())
    return x.select(F.get("__pair", F.lit(1)).alias("label"), F.get("__pair", F.lit(0)).alias("utterance"), "split",
                    F.struct("__split_no", "__file", "__block", "__row", "__pos").alias("ord_key"))


def read_json_examples(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``{rasa_nlu_data: {common_examples: [{text, intent}, ...]}}``; ``multi_line`` as for S4."""
    if multi_line:
        e = SP.json_elements(spark, path, 3, "{").where("list = 'common_examples'").withColumn("e", F.from_json("element", "text STRING, intent STRING"))
        return e.select(F.col("e.intent").alias("label"), F.col("e.text").alias("utterance"),
                        F.struct("__file", F.lit(0).cast("long").alias("__block"), F.col("__gid").alias("__row"), F.lit(0).alias("__pos")).alias("ord_key"))
    schema = "rasa_nlu_data STRUCT<common_examples: ARRAY<STRUCT<text: STRING, intent: STRING>>>"
    df = arrival_key(spark.read.schema(schema).json(path))
    ex = df.select("__file", "__block", "__row",
                   F.posexplode("rasa_nlu_data.common_examples").alias("__pos", "e"))
    return ex.select(F.col("e.intent").alias("label"), F.col("e.text").alias("utterance"),
                     F.struct("__file", "__block", "__row", "__pos").alias("ord_key"))


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    """One label per line (stripped, blanks skipped)."""
    return spark.read.text(path).select(strip(F.col("value")).alias("label")).where(F.col("label") != "")


def read_word_vectors_json(spark: SparkSession, path: str, nmax: int | None = None,
                           multi_line: bool = False) -> DataFrame:
    """JSON arrays (or objects) of ``{word, vec}``.  With ``nmax`` it keeps
    the first **nmax + 1** entries in file order, as the reference's loop does
    (it breaks only when i > nmax).  Adds ``word_id`` in file order (W4).  ``multi_line``: one array per file, as for S4."""
    if multi_line:
        e = SP.json_elements(spark, path, 1, "{").withColumn("e", F.from_json("element", "word STRING, vec ARRAY<FLOAT>"))
        df = e.select("e.*", "__file", F.lit(0).cast("long").alias("__block"), F.col("__gid").alias("__row"))
    else:
        df = arrival_key(spark.read.schema("word STRING, vec ARRAY<FLOAT>").json(path))
    df = df.where(F.col("word").isNotNull())
    if nmax is not None:
        df = df.orderBy("__file", "__block", "__row").limit(nmax + 1)
    return with_ord(df, out="word_id").select("word", "vec", F.col("word_id").cast("int").alias("word_id"))


def read_word2vec_text(spark: SparkSession, path: str, nmax: int | None = None) -> DataFrame:
    """word2vec text: a ``count dim`` header line, then ``word v1 ... vd``.
    Keeps the first ``nmax`` vectors in file order.

    The header is the first line of a file that holds just two whole numbers, so one-value vectors stay."""
    f = arrival_key(spark.read.text(path)).withColumn("__f", F.split(strip(F.col("value")), " "))
    at = F.struct("__block", "__row")
    numbers = (F.size("__f") == 2) & F.forall("__f", lambda x: x.rlike("^[0-9]+$"))
    heads = f.where(numbers).groupBy("__file").agg(F.min(at).alias("__head"))  # a row per file
    heads = heads.where(F.col("__head.__block") == 0)
    body = f.join(heads, "__file", "left").where((F.size("__f") > 1) & (F.col("__head").isNull() | (at != F.col("__head"))))
    if nmax is not None:
        body = body.orderBy("__file", "__block", "__row").limit(nmax)
    body = body.select("__file", "__block", "__row", F.element_at("__f", 1).alias("word"),
                       F.transform(F.slice("__f", 2, F.size("__f") - 1), lambda x: x.cast("float")).alias("vec"))
    return with_ord(body, out="word_id").select("word", "vec", F.col("word_id").cast("int").alias("word_id"))


def read_folds(spark: SparkSession, root: str, fmt: str = "tsv", multi_line: bool = False) -> DataFrame:
    """``root/fold=<n>/...`` folders of one layout read in one scan; the
    ``fold`` partition column comes from the folder names."""
    if fmt == "tsv":
        return (spark.read.schema("label STRING, utterance STRING, fold INT").option("sep", "\t")
                .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
                .option("multiLine", multi_line).option("header", False).csv(root))
    return spark.read.parquet(root)
