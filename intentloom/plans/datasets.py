"""Dataset presets: the reference's per-dataset entry points as one call.

``build_dataset(spark, name, paths)`` reads the dataset's layout, keeps file
order as ``ord`` (files in the given order, then position in file), and runs
the split plan with that dataset's rules:

* clinc150  - JSON object of lists (val, test, train), 50 novel labels
* banking77 - header CSV ``text``/``category`` (train then test), 27 novel
* atis      - nested JSON examples (test then train), '+'/'_' in labels become
              blanks, classes under 10 utterances dropped before the novel draw, 4 novel
* custom    - header CSV ``"0"`` (label) / ``"1"`` (utterance), ``pct`` percent
              novel, train share 1/2, one K
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentloom import constants as C
from intentloom.operators import labels as L
from intentloom.operators import split as S
from intentloom.sources import readers as R


@dataclass(frozen=True)
class Preset:
    layout: str
    novel_m: int | None = None
    novel_pct: int | None = None
    share: tuple = C.TRAIN_SHARE
    min_class: int | None = None
    normalize: bool = False


PRESETS = {
    "clinc150": Preset("json_pairs", novel_m=C.NOVEL_CLINC150),
    "banking77": Preset("csv_text_category", novel_m=C.NOVEL_BANKING77),
    "atis": Preset("json_examples", novel_m=C.NOVEL_ATIS, min_class=C.MIN_CLASS_ATIS, normalize=True),
    "custom": Preset("csv_01", novel_pct=C.NOVEL_PERCENT_CUSTOM, share=C.CUSTOM_TRAIN_SHARE),
}


def read_layout(spark: SparkSession, layout: str, paths: list[str], multi_line: bool = True) -> DataFrame:
    """Canonical ``(uid, utterance, label, ord)`` from one or more files of a layout."""
    parts = []
    for i, p in enumerate(paths):
        if layout == "json_pairs":
            df = R.read_json_pairs(spark, p, multi_line=multi_line).select("label", "utterance", "ord_key")
        elif layout == "json_examples":
            df = R.read_json_examples(spark, p, multi_line=multi_line)
        else:
            text_col, label_col = ("text", "category") if layout == "csv_text_category" else ("1", "0")
            df = R.keyed_csv(spark, p, text_col, label_col, multi_line)
            df = df.select("label", "utterance", F.struct("__file", "__block", "__row").alias("ord_key"))
        parts.append(df.select("label", "utterance", F.struct(F.lit(i).alias("f"), "ord_key").alias("__k")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    r = R.with_ord(u, keys=("__k",), out="ord")
    return r.select(F.col("ord").alias("uid"), "utterance", "label", "ord")


def build_dataset(spark: SparkSession, name: str, paths: list[str], shots=C.SHOTS,
                  pct: int | None = None, seed: int = C.SEED,
                  multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(split, roles)`` for a named dataset (see module doc).  JSON inputs
    are single documents per file (``multi_line=True``, the reference's form)
    or one document per line (``False``, as our writers produce)."""
    pre = PRESETS[name]
    utts = read_layout(spark, pre.layout, paths, multi_line)
    if pre.normalize:
        utts = L.normalize_labels(utts)
    if pre.min_class is not None:
        dedup = L.min_class_size(L.dedup_last_wins(utts), pre.min_class)
        labels = L.distinct_labels(dedup)
    else:
        dedup = L.dedup_last_wins(utts)
        labels = L.distinct_labels(utts)
    roles = L.choose_novel(labels, pct=pct if pct is not None else pre.novel_pct, m=pre.novel_m, seed=seed)
    num, den = pre.share
    return S.split_sets(dedup, roles, shots=shots, num=num, den=den, seed=seed), roles


def move_class(split: DataFrame, label: str) -> DataFrame:
    """SNIPS-style: move one label from seen to novel in an existing split."""
    spark = split.sparkSession
    return S.reassign_class(split, spark.createDataFrame([(label,)], "label string"))
