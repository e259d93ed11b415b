"""Secret scan: patterns of known kinds, and sliding-window entropy over candidate strings.  Column expressions only.

* *Base kinds* (``assign``, ``access``, ``hex``) are regular expressions, leftmost and without overlaps per kind; a match that
  fails its kind's length test is dropped, and its characters are used up.  A span is the whole match.
* *Entropy kinds.*  For each character class (``CLASSES``: name, characters, window, bits) the candidates are the
  maximal runs of its characters of a window or more.  The window slides over a candidate by one character at a
  time: with f(c) = c log2 c, a character that enters next to c of its own adds f(c+1) - f(c) to the window's sum, one that
  leaves c of its own subtracts f(c) - f(c-1), and the entropy is log2(w) - sum / w.  These counts and steps are window
  functions over (candidate, character) and (candidate) rows, f is in integers of 2^-32, so sums are exact in any order.
  Windows of ``bits`` or more that overlap or touch are one span.
* *Allow-list.*  Candidates that match an entry of ``ALLOW`` as a whole (words, numbers, documented examples, ordered
  alphabets) are suppressed.  Base spans are never suppressed.

Positions come from the lengths of the pieces between matches and running sums, so nothing is searched twice.  Only rows
with a match go on from the scan, without their texts.  Each different candidate is judged once, however often it
is copied, in segments of ``_SEGMENT`` characters that overlap by a window, so no task holds more than a segment's characters at
a time.

Defined results: positions count code points, ends are exclusive; a null text is empty; texts without spans have the digest of the
empty string and empty ``spans``; null ids are ids; repeated rows are each returned; empty tables give no rows; extra columns play
no part; texts of any length are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intentloom.llm.common import doc_key, stored
from intentloom.operators.joins import checked_broadcast

# fixed values: name, pattern, group whose length counts, least length; the last two patterns hold their length test, since within a
# run of their characters no later match can be longer than a failing one
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
]
# entropy kinds: name, characters, window, bits
CLASSES = [
    ("entropy_hex", "0-9A-Fa-f", 16, 3.05),
    ("entropy_alnum", "A-Za-z0-9", 20, 3.75),
    ("entropy_base64", "A-Za-z0-9+/_=-", 32, 4.35),
]
ALLOW = ["[0-9]+", "[a-z]+", "[A-Z]+", "[A-Z][a-z]+", ".*EXAMPLE.*", "(?i:(0123456789)+(abcdef)*)", "(?i:.*abcdefghijklmnop.*)"]
_SEGMENT, _ONE = 4096, 1 << 32


def _matches(text: Column, number: int, pattern: str, group: int, least: int, with_text: bool) -> Column:
    """All matches as ``array<struct<k, gap, len, ok, hit>>``: the characters between matches, and the match's own."""
    gap = F.transform(F.split(text, pattern, -1), F.char_length)
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hit
    every = F.filter(F.arrays_zip(gap.alias("gap"), hit.alias("hit"), part.alias("part")), lambda m: m["hit"].isNotNull())
    found = F.transform(every, lambda m: F.struct(
        F.lit(number).alias("k"), m["gap"].alias("gap"), F.char_length(m["hit"]).alias("len"), (F.char_length(m["part"]) >= least).alias("ok"),
        (m["hit"] if with_text else F.lit(None).cast("string")).alias("hit")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<k:int,gap:int,len:int,ok:boolean,hit:string>>"))


def _found(text: Column, classes) -> Column:
    parts = [_matches(text, i, p, g, n, False) for i, (_, p, g, n) in enumerate(BASE)]
    runs = [_matches(text, len(BASE) + i, f"(?<![{chars}])[{chars}]{{{w},}}", 0, w, True) for i, (_, chars, w, _) in enumerate(classes)]
    least = min((w for _, _, w, _ in classes), default=0)
    some = "".join(chars.replace("-", r"\-") if chars.endswith("-") else chars for _, chars, _, _ in classes)
    long = F.when(text.rlike(f"[{some}]{{{least},}}"), F.concat(*runs)) if runs else F.lit(None)
    return F.concat(*parts, F.coalesce(long, F.array().cast("array<struct<k:int,gap:int,len:int,ok:boolean,hit:string>>")))


def _hot_windows(runs: DataFrame, window: int, bits: float) -> DataFrame:
    """Different candidates ``runs(run, hit)`` -> ``run, s, e``: merged spans of windows of ``bits`` or more."""
    steps = F.lit([round(c * math.log2(c) * _ONE) if c else 0 for c in range(window + 1)])
    most = math.floor((math.log2(window) - bits) * window * _ONE)
    pieces = F.regexp_extract_all("hit", F.lit("(?s).{1,%d}" % _SEGMENT), F.lit(0))
    both = F.arrays_zip(pieces.alias("a"), F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))).alias("b"))
    segments = runs.select("run", F.posexplode(both).alias("j", "p")).select(
        "run", "j", F.concat("p.a", F.coalesce(F.substring("p.b", 1, window - 1), F.lit(""))).alias("seg"))
    chars = segments.filter(F.char_length("seg") >= window).select("run", "j", F.posexplode(F.split("seg", "")).alias("i", "ch"))
    own = W.partitionBy("run", "j", "ch").orderBy("i")
    before, after = F.count("*").over(own.rangeBetween(1 - window, -1)), F.count("*").over(own.rangeBetween(0, window - 1))
    stepped = chars.select("run", "j", "i", (F.get(steps, before.cast("int") + 1) - F.get(steps, before.cast("int"))).alias("enter"),
                           (F.get(steps, after.cast("int") - 1) - F.get(steps, after.cast("int"))).alias("leave"))
    along = W.partitionBy("run", "j").orderBy("i")
    stepped = stepped.withColumn("step", F.col("enter") + F.coalesce(F.lag("leave", window).over(along), F.lit(0)))
    sums = stepped.withColumn("sum", F.sum("step").over(along.rowsBetween(W.unboundedPreceding, 0)))
    hot = sums.filter((F.col("i") >= window - 1) & (F.col("sum") <= most)).select(
        "run", (F.col("j") * _SEGMENT + F.col("i") - (window - 1)).alias("s"))
    order = W.partitionBy("run").orderBy("s")
    hot = hot.withColumn("new", (F.col("s") > F.coalesce(F.lag("s").over(order) + window, F.lit(-1))).cast("int"))
    hot = hot.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return hot.groupBy("run", "island").agg(F.min("s").alias("s"), (F.max("s") + window).alias("e")).drop("island")


def _located(docs: DataFrame, classes, allow):
    """``(rows without a match, spans)``: spans have (doc_id, doc, th, copies, k, start, end), and k null where a
    row has only failing matches."""
    text = F.coalesce("text", F.lit(""))
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", doc_key().alias("doc"), F.md5("text").alias("th"), _found(F.col("text"), classes).alias("found"))
    scanned = stored(scanned, "secret-matches")
    key = ["doc_id", "doc", "th", "copies"]
    rows = scanned.filter(F.size("found") > 0).groupBy("doc_id", "doc", "th").agg(F.count("*").alias("copies"), F.first("found").alias("found"))
    each = rows.select(*key, F.posexplode("found").alias("i", "m")).select(*key, "i", "m.*")
    so_far = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("doc", "th", "k").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    each = each.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("len"))
    each = stored(each.withColumn("run", F.md5("hit")), "secret-spans")
    spans = each.select(*key, F.when(F.col("ok") & (F.col("k") < len(BASE)), F.col("k")).alias("k"), "start", "end")
    judged = each.filter(F.col("hit").isNotNull())
    if allow:
        judged = judged.filter(~F.col("hit").rlike("^(?s:" + "|".join(f"(?:{a})" for a in allow) + ")$"))
    for n, (_, _, window, bits) in enumerate(classes, len(BASE)):
        mine = judged.filter(F.col("k") == n)
        hot = checked_broadcast(_hot_windows(mine.select("run", "hit").distinct(), window, bits))
        spans = spans.unionByName(mine.join(hot, "run").select(
            *key, "k", (F.col("start") + F.col("s")).alias("start"), (F.col("start") + F.col("e")).alias("end")))
    return scanned, spans


def kinds(classes=CLASSES) -> list[str]:
    return [b[0] for b in BASE] + [c[0] for c in classes]


def secret_spans(docs: DataFrame, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """One row per span of each different row of ``docs(doc_id, text)``: doc_id, th (md5 of the text), kind, start, end."""
    _, spans = _located(docs, classes, allow)
    return spans.filter(F.col("k").isNotNull()).select("doc_id", "th", F.get(F.lit(kinds(classes)), F.col("k")).alias("kind"), "start", "end")


def secret_digests(docs: DataFrame, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """Every row of ``docs(doc_id, text)``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Spans read ``kind:start:end``, by start, then kind, joined by commas; ``base_sha256`` is of the base ones."""
    scanned, spans = _located(docs, classes, allow)
    listed = kinds(classes)
    names = F.lit(listed)
    span = F.when(F.col("k").isNotNull(), F.struct("start", "k", "end"))
    rows = spans.groupBy("doc_id", "doc", "th", "copies").agg(F.sort_array(F.collect_list(span)).alias("all"))
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")
    count = lambda low, high: F.size(F.filter("all", lambda s: s["k"].between(low, high))).cast("long")
    rows = rows.select("doc_id", *(count(i, i).alias(f"n_{b[0]}") for i, b in enumerate(BASE)),
                       F.sha2(written(F.filter("all", lambda s: s["k"] < len(BASE))), 256).alias("base_sha256"), written(F.col("all")).alias("spans"),
                       count(len(BASE), len(listed)).alias("n_entropy"), F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")
    none = scanned.filter(F.size("found") == 0).select("doc_id", *(F.lit(0).cast("long").alias(f"n_{b[0]}") for b in BASE),
                                                       F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_entropy"))
    return rows.unionByName(none)
