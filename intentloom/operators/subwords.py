"""Subword ids by greedy longest match over a given vocabulary of pieces.

A word is cut from its start: the longest piece that fits, then the longest continuing piece (written with ``##``)
of what is left, and so on; a word that cannot be cut to its end is one unknown id.

A vocabulary within a block's bytes is broadcast, and words are cut where they are: an Arrow batch cuts each of its
different words once and gives runs of one text's words, so a text is shuffled as a few runs, and no word is shuffled or joined.
A larger vocabulary stays a table: only different words are cut, on built-ins, every place of a word is joined once with the
pieces that could begin there, the longest is kept per place, and the cuts are followed in the row.  Words then come back to the
texts by a join in which no hot word is shuffled.  Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.operators.joins import BLOCK_BYTES, checked_broadcast, hot_join, table_bytes
from intentloom.session import materialize

UNKNOWN_PIECE = 100   # fixed values of the usual piece vocabularies: the unknown id, the mark of a continuing
MARK = "##"           # piece, and the longest word that is cut
MAX_WORD = 100


def word_pieces(words: DataFrame, pieces: DataFrame, unknown_id: int = UNKNOWN_PIECE) -> DataFrame:
    """``words(token)`` (different) and ``pieces(piece, piece_id)`` -> ``token, ids ARRAY<INT>``."""
    bare = F.when(F.col("piece").startswith(MARK), F.substring("piece", len(MARK) + 1, MAX_WORD)).otherwise(F.col("piece"))
    longest = pieces.agg(F.max(F.char_length(bare))).first()[0] or 0
    n = F.char_length("token")
    able = words.where((n > 0) & (n <= MAX_WORD))
    at = able.select("token", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    cuts = at.select("token", "at", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("at"), F.lit(longest)))).alias("len")) if longest else None
    if cuts is None:
        return words.select("token", F.array(F.lit(unknown_id)).alias("ids"))
    part = F.substring(F.col("token"), F.col("at") + 1, F.col("len"))
    cuts = cuts.withColumn("piece", F.when(F.col("at") > 0, F.concat(F.lit(MARK), part)).otherwise(part))
    best = cuts.join(checked_broadcast(pieces.select("piece", "piece_id")), "piece").groupBy("token", "at").agg(
        F.max(F.struct("len", F.col("piece_id").cast("int").alias("id"))).alias("b"))
    places = best.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("at", "b"))).alias("m"))

    def step(s, i):
        here = F.element_at(F.col("m"), i)
        move = (i == s["at"]) & here.isNotNull()
        return F.struct(F.when(move, i + here["len"]).otherwise(s["at"]).alias("at"), F.when(move, F.concat(s["ids"], F.array(here["id"]))).otherwise(s["ids"]).alias("ids"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
    done = places.withColumn("s", F.aggregate(F.sequence(F.lit(0), n - 1), start, step))
    done = done.select("token", F.when(F.col("s.at") == n, F.col("s.ids")).alias("ids"))
    return words.join(done, "token", "left").select("token", F.coalesce("ids", F.array(F.lit(unknown_id))).alias("ids"))


def cut_word(word: str, heads: dict[str, int], tails: dict[str, int], head: int, tail: int, unknown_id: int = UNKNOWN_PIECE) -> list[int]:
    """The ids of one word: the longest piece that fits its start (of ``head`` characters at most), then continuing ones."""
    n, at, out = len(word), 0, []
    if not 0 < n <= MAX_WORD:
        return [unknown_id]
    fits, longest = heads, head
    while at < n:
        for end in range(min(n, at + longest), at, -1):
            piece = word[at:end]
            if piece in fits:
                out.append(fits[piece])
                at = end
                break
        else:
            return [unknown_id]
        fits, longest = tails, tail
    return out


KNOWN_WORDS = 200_000  # cut words that a task remembers at a time


def _runs(toks: DataFrame, pieces: DataFrame, key: str, unknown_id: int) -> DataFrame:
    """``(key, first, last, pos, end, ids)``: the words of ``toks`` cut in place, a row for each run of one key with rising
    positions in a batch; ``end`` says how many of ``ids`` come up to each word."""
    # the vocabulary is within a block's bytes; of pieces that repeat, the largest id
    few = pieces.where(F.col("piece").isNotNull()).groupBy("piece").agg(F.max(F.col("piece_id").cast("int")).alias("id")).collect()
    longest = min(MAX_WORD, max((len(r["piece"].removeprefix(MARK)) for r in few), default=0))  # as ``word_pieces`` has it
    heads = {r["piece"]: r["id"] for r in few if len(r["piece"]) <= longest}
    tails = {p: r["id"] for r in few if r["piece"].startswith(MARK) and len(p := r["piece"].removeprefix(MARK)) <= longest}
    most = [max(map(len, d), default=0) for d in (heads, tails)]
    vocab = toks.sparkSession.sparkContext.broadcast((heads, tails, *most, unknown_id))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(key, toks.schema[key].dataType), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
                           *(T.StructField(c, ints) for c in ("pos", "end", "ids"))])

    def run(batches):
        vocabulary, known = vocab.value, {}
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column(2).dictionary_encode()
            here = words.dictionary.to_pylist()
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in here:
                if w not in known:
                    known[w] = cut_word(w, *vocabulary) if w else []
            cuts = pa.array([known[w] for w in here], pa.list_(pa.int32())).take(words.indices)
            pos = b.column(1).to_numpy()
            code = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.r_[True, (code[1:] != code[:-1]) | (pos[1:] <= pos[:-1])]
            start = np.flatnonzero(new)
            ends = np.r_[start[1:], b.num_rows]
            total = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(cuts), 0).to_numpy())].astype(np.int32)
            rows = pa.array(np.r_[start, b.num_rows].astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(start)), pa.array(pos[start]), pa.array(pos[ends - 1]), pa.ListArray.from_arrays(rows, b.column(1)),
                pa.ListArray.from_arrays(rows, pa.array(total[1:] - total[start][np.cumsum(new) - 1])),
                pa.ListArray.from_arrays(pa.array(np.r_[total[start], total[-1]]), cuts.flatten())], [f.name for f in schema])

    return toks.select(key, F.col("pos").cast("int").alias("pos"), "token").mapInArrow(run, schema)


def _joined(runs):
    """The ids of a text from its runs: one after the other, or, where runs overlap (a repeated key), word by word."""
    apart = F.forall(F.zip_with(F.slice(runs, 1, F.size(runs) - 1), F.slice(runs, 2, F.size(runs) - 1), lambda a, b: a["last"] < b["first"]), lambda x: x)

    def words(r):
        start = lambda i: F.coalesce(F.get(r["end"], i - 1), F.lit(0))
        return F.transform(r["pos"], lambda p, i: F.struct(p.alias("pos"), F.slice(r["ids"], start(i) + 1, F.get(r["end"], i) - start(i)).alias("ids")))

    mixed = F.sort_array(F.flatten(F.transform(runs, words)))
    return F.when(apart, F.flatten(F.transform(runs, lambda r: r["ids"]))).otherwise(F.flatten(F.transform(mixed, lambda w: w["ids"])))


def subword_ids(toks: DataFrame, pieces: DataFrame, key: str = "uid", unknown_id: int = UNKNOWN_PIECE, max_bytes: int | None = None) -> DataFrame:
    """``(key, ids ARRAY<INT>)``: the subword ids of each text of ``toks(key, pos, token)`` in order; empty tokens give none."""
    pieces = materialize(pieces, "pieces")
    if table_bytes(pieces) <= (BLOCK_BYTES if max_bytes is None else max_bytes):
        runs = F.struct("first", "last", "pos", "end", "ids")
        g = _runs(toks, pieces, key, unknown_id).groupBy(key).agg(F.sort_array(F.collect_list(runs)).alias("s"))
        return g.select(key, _joined(F.col("s")).alias("ids"))
    words = toks.where(F.col("token") != "").select("token").distinct()
    j = hot_join(toks, word_pieces(words, pieces, unknown_id), "token", max_bytes=max_bytes)
    g = j.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("s"))
    return g.select(key, F.flatten(F.transform("s", lambda s: F.coalesce(s["ids"], F.array().cast("array<int>")))).alias("ids"))
