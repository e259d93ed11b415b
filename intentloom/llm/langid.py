"""Language identification by words first, with backoff to character n-grams.

The model holds, for each learned language, the log frequency of its words, and of the character
n-grams (5 to 1, with word ends) of its words.  A known word is scored by its per-language log
frequency.  An unseen word falls back to its 5-grams that the model knows; if there are none, to
4-grams, and so on.  A text's score is the sum over all its words; the prediction is the best
language, and ``score`` its posterior probability.

Learning is from a bounded sample of the labelled rows: the ``per_language`` different texts of each
language with the least hashes (all, if it has fewer), each counted once however often it is copied.  So every language
with a text is learned, and one with a third of all rows, or a text with a third of a language's, is no larger
than the others.  The model holds every word and n-gram of the sample.  Prediction covers every whole text and reads
only the text.

Defined results: ``und`` with score 0 if the text is null or has no letters, or if nothing was
learned; rows with null lang or text are not learned from; equal scores go to the language that sorts first; repeated rows are predicted alike; an
empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intentloom.llm.common import stored
from intentloom.operators.joins import checked_broadcast

ORDERS = (5, 4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_BYTES = 32 << 20  # of the scores that a task remembers


class Entries:
    """The entries of one order with their per-language figures, in flat arrays: the entries' 64-bit hashes, ascending, and for
    each the number of its tuple among the different ones.  About 12 bytes an entry, in every task that predicts."""

    def __init__(self, entries: list[str] = (), rows: list[int] = (), values: list[tuple] = ()):
        hashes = np.array([xxhash.xxh64_intdigest(e) for e in entries], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.rows, self.values = array("Q", hashes[order].tobytes()), array("I", np.array(rows, np.uint32)[order].tobytes()), values

    def get(self, entry: str):
        h = xxhash.xxh64_intdigest(entry)
        i = bisect_left(self.hashes, h)
        return self.values[self.rows[i]] if i < len(self.hashes) and self.hashes[i] == h else None

    def __contains__(self, entry: str) -> bool:
        return self.get(entry) is not None

    def __len__(self) -> int:
        return len(self.hashes)


def letters(text: str) -> list[str]:
    """Runs of letters, lower case."""
    return _WORD.findall(text.lower())


def _clean(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _ngrams(word: str, n: int):
    if n == 1:
        return list(word)
    w = f" {word} "
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def _count(batches):
    """Texts with labels -> counts per language, order (0: words) and entry, added up per batch."""
    for b in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(letters(text))
        out: Counter = Counter()
        for lang, counts in words.items():
            for word, c in counts.items():
                if word := _clean(word):
                    out[lang, 0, word] += c
                    for n in ORDERS:
                        for g in _ngrams(word, n):
                            out[lang, n, g] += c
        keys = list(out)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "n": pa.array([k[1] for k in keys], pa.int32()),
                                          "entry": pa.array([k[2] for k in keys], pa.string()), "c": pa.array([out[k] for k in keys], pa.int64())})


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """``lang, text``: of each language the ``per_language`` different texts with the least hashes, once each."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("th"))
    texts = stored(rows.select("lang", "th").distinct(), "lang-texts")
    # only hashes that can be among the least are ranked, a few thousand a language: four times as many as are drawn
    least = F.lit(4.0 * per_language) / F.col("n")
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"))
    texts = texts.join(checked_broadcast(sizes), "lang").filter(F.col("th") / F.lit(2.0 ** 64) + 0.5 < least)
    texts = texts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("th"))).filter(F.col("r") <= per_language)
    drawn = rows.join(F.broadcast(stored(texts.select("lang", "th"), "lang-sample")), ["lang", "th"], "left_semi")  # per_language rows per language
    return drawn.groupBy("lang", "th").agg(F.first("text").alias("text")).select("lang", "text")


def learn(labelled: DataFrame, per_language: int = 1000) -> dict:
    """The model of ``labelled(text, lang)``: languages, and log frequencies per word and n-gram of the sample."""
    counts = stored(sample(labelled, per_language).mapInArrow(_count, "lang string, n int, entry string, c long").groupBy("lang", "n", "entry").agg(
        F.sum("c").alias("c")), "lang-counts")
    totals = {(r.lang, r.n): r.c for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return {"langs": [], "tables": {n: Entries() for n in (0, *ORDERS)}}
    per = counts.groupBy("n", "entry").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("c"))), F.lit(0)).alias(f"c{i}") for i, lang in enumerate(langs)))
    found: dict[int, tuple] = {n: ([], []) for n in (0, *ORDERS)}
    alike: dict[tuple, int] = {}  # most entries are rare and share their figures with others
    values: list[tuple] = []
    for b in per.toArrow().to_batches(1 << 16):
        orders, entries = b.column("n").to_pylist(), b.column("entry").to_pylist()
        for n, entry, *c in zip(orders, entries, *(b.column(f"c{i}").to_pylist() for i in range(len(langs)))):
            row = alike.setdefault((n, *c), len(values))
            if row == len(values):  # an entry that a language lacks has half a count there
                values.append(tuple(math.log((x + 0.5) / (totals.get((lang, n), 0) + 1.0)) for lang, x in zip(langs, c)))
            found[n][0].append(entry)
            found[n][1].append(row)
    tables = {n: Entries(entries, rows, values) for n, (entries, rows) in found.items()}
    return {"langs": langs, "tables": tables}


def score_word(model: dict, word: str):
    """The word's per-language log frequencies, or the sum over its longest known n-grams, with the number of
    entries summed (0: nothing known)."""
    tables = model["tables"]
    hit = tables[0].get(word)
    if hit is not None:
        return hit, 1
    padded = f" {word} "
    for n in ORDERS:
        text, get = (padded, tables[n].get) if n > 1 else (word, tables[n].get)
        known = [v for i in range(len(text) - n + 1) if (v := get(text[i:i + n]))]
        if len(known) == 1:
            return known[0], 1
        if known:
            return tuple(map(sum, zip(*known))), len(known)
    return (), 0


class Classifier:
    """Predicts texts one by one; remembers the scores of the words it has met, in bounded memory."""

    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.most = min(1 << 18, _CACHE_BYTES // (8 * max(1, len(self.langs))))
        self._forget(0)

    def _forget(self, need: int):
        self.scores = np.zeros((max(self.most, need + 2), max(1, len(self.langs))))
        self.rows: dict[str, int] = {}
        self.used = 2  # row 0: no letters; row 1: letters the model knows nothing of

    def _add(self, words: list[str]) -> None:
        found, parts, row = [], [], self.used
        for word in words:
            clean = _clean(word)
            v, n = score_word(self.model, clean) if clean else ((), 0)
            if n:
                found.append(v)
                parts.append(n)
                self.rows[word] = row
                row += 1
            else:
                self.rows[word] = 1 if clean else 0
        if found:
            self.scores[self.used:row] = np.array(found) / np.array(parts)[:, None]
            self.used = row

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = Counter(letters(text)) if text else Counter()
        get = self.rows.get
        rows = [get(w) for w in counts]
        if None in rows:
            if len(self.rows) + len(counts) + 2 > len(self.scores):
                self._forget(len(counts))
                rows = [None] * len(rows)
            self._add([w for w, r in zip(counts, rows) if r is None])
            rows = [self.rows[w] for w in counts]
        if not self.langs or not any(rows):
            return "und", 0.0
        total = np.fromiter(counts.values(), np.float64, len(rows)) @ self.scores[rows]
        best = int(total.argmax())
        return self.langs[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())


def identify(docs: DataFrame, model: dict, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``carry``, by default all) with ``lang_pred`` and ``score``; reads only ``text``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    carry = list(docs.columns) if carry is None else carry
    source = "text" if "text" in carry else "_text"
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        predict = Classifier(shared.value)
        for b in batches:
            got = [predict(t.as_py()) for t in b.column(source)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())], names=[*carry, "lang_pred", "score"])

    return docs.select(*carry, *([] if source == "text" else [F.col("text").alias(source)])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are not learned from: crc32 of the id's text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1
