"""Large single documents read by many tasks: JSON arrays and CSV with quoted newlines.

A reader that must know where a quote or bracket was opened reads a file from its start, in one task.  Here a file
is read in the splits that Spark cuts anyway, into *pieces* (text up to the next closing bracket, or a line), and what
came before a piece is worked out afterwards:

1. Each piece says what it does to the state (inside or outside quotes) from either start: a transition function.
2. Per split, these are composed (a window over the split's pieces); the few splits' own transitions are
   composed along the file (a row per split); so every piece learns its true start state.  Depths and
   record numbers are running sums by the same two steps.
3. Pieces that hold a whole record, nearly all, are parsed where they are.  Only records cut by a closing
   bracket inside a string, by nested objects or by a newline inside quotes are put together by a shuffle.

No task holds more than a split's pieces, and files of any size are many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intentloom.operators.joins import checked_broadcast
from intentloom.session import materialize

SPLIT = ["__file", "__block"]
_BACKSLASH, _QUOTE = "\uffff\ufffd", "\uffff\ufffe"  # stand for an escaped backslash and quote: no characters of any text


def _odd(n) -> Column:
    return n % 2 == 1


def _turn(start, row) -> Column:
    """The state after rows that are summed up as (const, turns): the last constant, if any, and the turns since."""
    return _odd(F.coalesce(row["const"]["state"], start).cast("int") + row["turns"] - F.coalesce(row["const"]["at"], F.lit(0).cast("long")))


def start_states(pieces: DataFrame, out: str) -> DataFrame:
    """``pieces`` with ``out``: the state (boolean) at their start, from ``__f0`` and ``__f1``, the states at their end if
    they start in state false or true.  A file starts in state false.  ``pieces`` must be a written table."""
    here = Window.partitionBy(*SPLIT).orderBy("__row")
    x = pieces.withColumn("__turn", (F.col("__f0") & ~F.col("__f1")).cast("long"))
    x = x.withColumn("__n", F.sum("__turn").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    const = F.when(F.col("__f0") == F.col("__f1"), F.struct(F.col("__f0").alias("state"), F.col("__n").alias("at")))
    so_far = lambda last: F.struct(F.last(const, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, last)).alias("const"),
                                   (F.col("__n") - (F.col("__turn") if last else F.lit(0))).alias("turns"))
    # per split: what it does as a whole, and the state it starts in
    whole = x.select(*SPLIT, "__row", so_far(0).alias("__s")).groupBy(*SPLIT).agg(F.max_by("__s", "__row").alias("__s"))
    along = Window.partitionBy("__file").orderBy("__block")
    turn = F.when(F.col("__s.const").isNull() & _odd(F.col("__s.turns")), 1).otherwise(0)
    w = whole.withColumn("__t", turn).withColumn("__n", F.sum("__t").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("__s.const").isNotNull(), F.struct(_turn(F.lit(False), F.col("__s")).alias("state"), F.col("__n").cast("long").alias("at")))
    w = w.withColumn("__b", F.struct(F.last(fixed, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("const"),
                                     (F.col("__n") - F.col("__t")).cast("long").alias("turns")))
    starts = checked_broadcast(w.select(*SPLIT, _turn(F.lit(False), F.col("__b")).alias("__start")))  # a row per split
    y = x.withColumn("__s", so_far(-1)).join(starts, SPLIT)
    return y.withColumn(out, _turn(F.col("__start"), F.col("__s"))).drop("__s", "__start", "__turn", "__n")


def running(pieces: DataFrame, value: str, out: str) -> DataFrame:
    """``pieces`` (a written table) with ``out``: the sum of ``value`` over the pieces before, in file order."""
    along = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy(*SPLIT).agg(F.sum(value).alias("__v"))
    sums = checked_broadcast(sums.select(*SPLIT, F.coalesce(F.sum("__v").over(along), F.lit(0)).alias("__from")))  # a row per split
    here = Window.partitionBy(*SPLIT).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(sums, SPLIT).withColumn(out, (F.col("__from") + F.coalesce(F.sum(value).over(here), F.lit(0))).cast("long")).drop("__from")


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    from intentloom.sources.readers import arrival_key
    return arrival_key(spark.read.option("lineSep", sep).text(path))


def _count(s, chars: str) -> Column:
    return (F.char_length(s) - F.char_length(F.translate(s, chars, ""))).cast("long")


def _records(x: DataFrame, ends: str, sep: str) -> DataFrame:
    """Pieces with the record number ``__gid`` (records that end before) -> one row per record that ends: __file, __gid, record."""
    here = Window.partitionBy(*SPLIT).orderBy("__row")
    x = x.withColumn("__alone", F.col(ends) & F.coalesce(F.lag(ends).over(here), F.lit(False)))
    one = x.where("__alone").select("__file", "__gid", F.col("value").alias("record"))
    parts = x.where("not __alone").groupBy("__file", "__gid").agg(
        F.array_sort(F.collect_list(F.struct("__block", "__row", "value"))).alias("p"), F.bool_or(ends).alias("whole"))
    return one.unionByName(parts.where("whole").select("__file", "__gid", F.array_join(F.transform("p", lambda p: p["value"]), sep).alias("record")))


def json_elements(spark: SparkSession, path: str, depth: int, opener: str) -> DataFrame:
    """The elements, that start with ``opener`` (``[`` or ``{``), of the arrays that lie ``depth`` brackets deep in the JSON
    document of each file: ``__file``, ``__gid`` (increases in file order), ``list`` (the key the array is under, null
    for a root array) and ``element`` (JSON text)."""
    closer = {"[": "]", "{": "}"}[opener]
    p = _pieces(spark, path, closer)
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters; a cut never parts an escape
    p = p.withColumn("__bare", bare).withColumn("__f0", _odd(_count("__bare", '"'))).withColumn("__f1", ~F.col("__f0"))
    x = start_states(materialize(p, "pieces"), "__in")
    outside = F.array_join(F.filter(F.split("__bare", '"', -1), lambda s, i: (i % 2 == 0) != F.col("__in")), "")
    x = x.withColumn("__after", F.col("__in") != F.col("__f0")).withColumn("__out", outside)
    x = x.withColumn("__by", _count("__out", "{[") - _count("__out", "}]") - F.when(F.col("__after"), 0).otherwise(1))
    x = materialize(x.drop("__bare", "__out", "__f0", "__f1", "__in"), "depths")
    x = running(x, "__by", "__depth").withColumn("__ends", ~F.col("__after") & (F.col("__depth") + F.col("__by") == depth))
    x = materialize(x.withColumn("__end", F.col("__ends").cast("long")), "ends")
    r = _records(running(x, "__end", "__gid"), "__ends", closer).withColumn("record", F.concat("record", F.lit(closer)))
    r = r.withColumn("__first", (F.col("__gid") == 0) | ~F.col("record").rlike(r"^[\s,]*" + "\\" + opener))
    r = materialize(r, "records")
    # a list's first element comes with what lies before it: its key, and where the element begins
    marked = F.replace(F.replace(F.col("record"), F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    plain = lambda c: F.replace(F.replace(c, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    firsts = r.where("__first").withColumn("__t", F.regexp_extract_all(marked, F.lit(r'"[^"]*+"|[\[\]{}:,]|[^\s\[\]{}:,"]+'), F.lit(0)))

    def step(s, t):
        opens, closes = t.isin("[", "{"), t.isin("]", "}")
        deep = s["depth"] + opens.cast("int") - closes.cast("int")
        name = F.when((t == ":") & (s["depth"] == depth - 1), s["last"]).when((deep < depth - 1) | (closes & (deep == depth - 1)), F.lit(None).cast("string")).otherwise(s["name"])
        return F.struct(deep.alias("depth"), (s["i"] + 1).alias("i"), t.alias("last"), name.alias("name"),
                        F.when(opens & (s["depth"] == depth), s["i"]).otherwise(s["at"]).alias("at"),
                        F.when(opens & (deep == depth), s["name"]).otherwise(s["list"]).alias("list"))

    zero = F.struct(F.when(F.col("__gid") == 0, F.lit(0)).otherwise(F.lit(depth)).alias("depth"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("last"),
                    F.lit(None).cast("string").alias("name"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("list"))
    firsts = firsts.withColumn("__s", F.aggregate("__t", zero, step))
    firsts = materialize(firsts.select("__file", "__gid", F.regexp_replace("__s.list", '^"|"$', "").alias("list"),
                                       plain(F.array_join(F.slice("__t", F.col("__s.at") + 1, F.size("__t")), "")).alias("element")), "lists")
    until = F.lead("__gid").over(Window.partitionBy("__file").orderBy("__gid"))  # a row per list
    spans = checked_broadcast(firsts.select(F.col("__file").alias("__of"), F.col("__gid").alias("__from"), until.alias("__to"), "list"))
    rest = r.where("not __first").join(spans, (F.col("__file") == F.col("__of")) & (F.col("__gid") > F.col("__from")) & (F.col("__to").isNull() | (F.col("__gid") < F.col("__to"))))
    return firsts.unionByName(rest.select("__file", "__gid", "list", F.regexp_replace("record", r"^[\s,]+", "").alias("element")))


def _quotes(text: Column, sep: str, start: bool) -> Column:
    """Struct of the state after a text (``in``: inside quotes) and the separators outside quotes (``seps``), from the state
    ``start``: a quote closes, or opens where a field starts; doubled quotes do neither."""
    count = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(sep), F.lit("")))
    lead = F.struct(F.lit(start).alias("in"), F.lit(None).cast("string").alias("before"), F.lit(0).alias("i"), F.lit(0).alias("seps"))

    def step(s, x):
        opens = F.when(s["i"] == 1, s["before"] == "").otherwise(F.lit(False)) | s["before"].endswith(sep)
        inside = F.when(s["i"] == 0, s["in"]).when(s["in"], F.lit(False)).otherwise(opens)
        return F.struct(inside.alias("in"), x.alias("before"), (s["i"] + 1).alias("i"), (s["seps"] + F.when(inside, 0).otherwise(count(x))).alias("seps"))

    return F.aggregate(F.split(F.replace(text, F.lit('""'), F.lit("")), '"', -1), lead, step)


def field_count(record: Column, sep: str) -> Column:
    """Fields of a record."""
    plain = F.char_length(record) - F.char_length(F.replace(record, F.lit(sep), F.lit("")))
    return 1 + F.when(record.contains('"'), _quotes(record, sep, False)["seps"]).otherwise(plain)


def left_open(record: Column, sep: str) -> Column:
    """Whether the record ends inside quotes."""
    return F.when(record.contains('"'), _quotes(record, sep, False)["in"]).otherwise(F.lit(False))


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The records of quoted text files, newlines inside quotes included: ``__file``, ``__gid`` (file order), ``record``.

    A quote opens a field only at its start, so a quote within an unquoted field is text; doubled quotes stay."""
    p = _pieces(spark, path, "\n")
    end = lambda start: _quotes(F.col("value"), sep, start)["in"]
    quoted = F.col("value").contains('"')
    p = p.withColumn("__f0", F.when(quoted, end(False)).otherwise(F.lit(False))).withColumn("__f1", F.when(quoted, end(True)).otherwise(F.lit(True)))
    x = start_states(materialize(p, "lines"), "__in")
    x = x.withColumn("__after", F.when(F.col("__in"), F.col("__f1")).otherwise(F.col("__f0")))
    # a record that the end of the file leaves open ends there
    ends = x.select("__file", "__block", "__row").groupBy("__file").agg(F.max(F.struct("__block", "__row")).alias("__eof"))
    x = x.join(checked_broadcast(ends), "__file").withColumn("__ends", ~F.col("__after") | (F.struct("__block", "__row") == F.col("__eof")))
    x = materialize(x.select("__file", "__block", "__row", "value", "__ends", F.col("__ends").cast("long").alias("__end")), "ends")
    r = _records(running(x, "__end", "__gid"), "__ends", "\n")
    return r.withColumn("record", F.regexp_replace("record", r"\r$", ""))
