"""Exact ranks without single-task windows.

``class_rank`` numbers the rows of every group in seeded-hash order.  A plain
``row_number() over (partition by label ...)`` puts a whole class in one task;
when one label holds a third of 100 TB that task never finishes.  Instead the
hash key is cut into a short prefix bucket (uniform, since it is md5):

1. count rows per (group, bucket)              -- partial aggregate, tiny output
2. running sum of those counts per group       -- window over <= 16**p rows
3. rank = offset(group, bucket) + row_number() within (group, bucket)

Step 3's window partitions hold about n / 16**p rows each, whatever the skew
of the group key.  The result equals the plain window exactly.

``global_rank`` does the same for an arbitrary sort order by range-partitioning,
checkpointing the sorted rows with their partition index, and adding the
per-partition offsets (the DataFrame form of ``zipWithIndex``).

``rank_cuts`` answers only "is the rank <= cut" for a few cuts: rows in
buckets wholly below or above every cut are settled against a broadcast
bucket table, and only the boundary buckets are ranked.

``group_top`` is the top-K form (partial WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intentloom.session import checkpoint_root, materialize


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on same-named keys with NULL-safe equality, keeping one copy of each key."""
    if not keys:
        raise ValueError("null_safe_join needs keys; a keyless join is a cross join")
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else (cond & c)
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def class_rank(df: DataFrame, by: list[str], order_key: str, tiebreak: list[str] | str,
               out: str = "rn", total: str | None = None, prefix_len: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based rank of each row inside its ``by`` group.

    Rows are ordered by ``order_key`` (a hex hash string, see
    ``functions.order.seeded_key``) and then ``tiebreak``.  If ``total`` is
    given, the group size is added under that name too.  ``by`` may be empty
    (one global order).

    The group key is packed into one struct column: struct equality treats
    NULL fields as equal (rows with a NULL label form their own group), and
    the join to the offsets and the final window partition on the same
    ``(group, bucket)`` columns, so the rows are shuffled once.
    """
    by = list(by)
    tiebreak = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    if prefix_len is None:
        # per-class ranks: 16**4 buckets per class; one global order (pairs can
        # number 10**13): 16**6 buckets, still one small running sum per group
        prefix_len = 4 if by else 6
    g = F.struct(*[F.col(b) for b in by]) if by else F.lit(0)
    x = df.withColumn("__cr_g", g).withColumn("__cr_b", F.substring(F.col(order_key), 1, prefix_len))
    counts = x.groupBy("__cr_g", "__cr_b").agg(F.count(F.lit(1)).alias("__cr_c"))
    wb = Window.partitionBy("__cr_g").orderBy("__cr_b")
    cols = ["__cr_g", "__cr_b",
            F.coalesce(F.sum("__cr_c").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__cr_o")]
    if total:
        cols.append(F.sum("__cr_c").over(Window.partitionBy("__cr_g")).cast("long").alias(total))
    offsets = counts.select(*cols)
    j = x.join(offsets, ["__cr_g", "__cr_b"])
    wr = Window.partitionBy("__cr_g", "__cr_b").orderBy(F.col(order_key), *[F.col(t) for t in tiebreak])
    return j.withColumn(out, (F.col("__cr_o") + F.row_number().over(wr)).cast("long")).drop("__cr_g", "__cr_b", "__cr_o")


def group_top(df: DataFrame, by: list[str], order: list, k, out: str = "rn") -> DataFrame:
    """Rows ranked ``<= k`` inside each group.

    The filter sits directly on ``row_number()``, so Spark plans a partial
    WindowGroupLimit before the shuffle: a hot group sends at most k rows per
    input partition over the wire.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    kk = F.lit(k) if isinstance(k, int) else k
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= kk).withColumn(out, F.col(out).cast("long"))


def global_rank(df: DataFrame, order: list, out: str = "rn") -> DataFrame:
    """1-based position of every row in a total order over arbitrary columns.

    The sorted rows are checkpointed (to the shared ``spark.checkpoint.dir``)
    together with their partition index and position, so the per-partition
    counts and the rows agree even if a task is re-run.  Only the per-partition
    count table (one row per partition) is broadcast.
    """
    checkpoint_root(df.sparkSession)
    s = (df.orderBy(*order)
         .withColumn("__pid", F.spark_partition_id())
         .withColumn("__mid", F.monotonically_increasing_id()))
    s = s.checkpoint(eager=True)
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__pc"))
    offs = counts.select("__pid", F.coalesce(
        F.sum("__pc").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__off"))
    # one row per partition: a proven size bound for the broadcast
    j = s.join(F.broadcast(offs), "__pid")
    return j.withColumn(out, (F.col("__off") + local + 1).cast("long")).drop("__pid", "__mid", "__off")


def small_rank(df: DataFrame, order: list, out: str = "rn", by: list[str] | None = None) -> DataFrame:
    """row_number() for label-sized tables (a few thousand rows at most).

    Only for tables whose size is bounded by the number of labels/steps, never
    by the number of utterances.
    """
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def rank_cuts(df: DataFrame, by: list[str], order_key: str, tiebreak: list[str] | str,
              cuts: dict, total: str = "n", prefix_len: int = 2,
              max_bucket_rows: int = 200_000, n_groups: int | None = None) -> DataFrame:
    """Flags ``<name> = rank <= cut`` for each named cut, without ranking every row.

    ``cuts`` maps a flag name to a function of the group-size Column (e.g.
    ``lambda n: floor(2n/3)``).  Rows are counted per (group, hash-prefix
    bucket); a bucket wholly below a cut has all its rows inside, one wholly
    above has none, and only the bucket holding the cut needs exact ranks.
    The bucket table (groups x 16**prefix_len rows, size-checked) is
    broadcast, so rows outside boundary buckets are classified where they
    are, with no shuffle; boundary rows (about (#cuts)/16**prefix_len of each
    group) are ranked with ``class_rank``.  Above the bound every row is
    ranked with ``class_rank`` instead.  Adds the flags and ``total``.

    The bound is ``n_groups * 16**prefix_len`` when the number of groups is
    known (no extra job); otherwise the bucket table is counted first.
    """
    by = list(by)
    tiebreak = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    g = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    x = df.withColumn("__grp", g).withColumn("__b1", F.substring(F.col(order_key), 1, prefix_len))
    counts = x.groupBy("__grp", "__b1").agg(F.count(F.lit(1)).alias("__bc"))
    wb = Window.partitionBy("__grp").orderBy("__b1")
    b = counts.select("__grp", "__b1", "__bc",
                      F.coalesce(F.sum("__bc").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                 F.lit(0)).alias("__off"),
                      F.sum("__bc").over(Window.partitionBy("__grp")).cast("long").alias(total))
    need = F.lit(False)
    for name, cut in cuts.items():
        thr = cut(F.col(total))
        b = b.withColumn(f"__thr_{name}", thr.cast("long"))
        full = F.col("__off") + F.col("__bc") <= F.col(f"__thr_{name}")
        none = F.col("__off") >= F.col(f"__thr_{name}")
        b = b.withColumn(f"__st_{name}", F.when(full, F.lit(1)).when(none, F.lit(0)).otherwise(F.lit(2)))
        need = need | (F.col(f"__st_{name}") == 2)
    b = b.withColumn("__need", need)
    if not by:
        n_groups = 1
    if n_groups is not None:
        too_big = n_groups * 16 ** prefix_len > max_bucket_rows
    else:
        b = materialize(b)
        too_big = b.count() > max_bucket_rows
    if too_big:
        # too many buckets to broadcast: rank every row (one shuffle)
        r = class_rank(df, by, order_key, tiebreak, out="__rn", total=total)
        for name, cut in cuts.items():
            r = r.withColumn(name, F.col("__rn") <= cut(F.col(total)))
        return r.drop("__rn")
    j = x.join(F.broadcast(b), ["__grp", "__b1"])  # bounded above
    helper = ["__grp", "__b1", "__bc", "__off", "__need"] + [f"__thr_{n}" for n in cuts] + [f"__st_{n}" for n in cuts]
    settled = j.where(~F.col("__need"))
    for name in cuts:
        settled = settled.withColumn(name, F.col(f"__st_{name}") == 1)
    edge = j.where(F.col("__need"))
    edge = class_rank(edge, ["__grp", "__b1"], order_key, tiebreak, out="__rn", prefix_len=prefix_len + 4)
    for name in cuts:
        st, thr = F.col(f"__st_{name}"), F.col(f"__thr_{name}")
        edge = edge.withColumn(name, (st == 1) | ((st == 2) & (F.col("__off") + F.col("__rn") <= thr)))
    return settled.drop(*helper).unionByName(edge.drop(*helper, "__rn"))


def keep_smallest(df: DataFrame, order_key: str, tiebreak: list[str], take, prefix_len: int = 4) -> DataFrame:
    """The ``take`` rows (a Column without row references, e.g. a scalar subquery) of least ``order_key``.

    ``df`` is evaluated twice: once for the counts of 16**prefix_len buckets, once for the rows of buckets
    up to the cut, which are written (as many as the result has, and one bucket more).  Only the
    bucket with the cut is ranked.
    """
    x = df.withColumn("__b1", F.substring(order_key, 1, prefix_len))
    counts = x.groupBy("__b1").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__b1").rowsBetween(Window.unboundedPreceding, -1)  # over 16**prefix_len rows
    b = counts.select("__b1", (take - F.coalesce(F.sum("__c").over(before), F.lit(0))).alias("__left"), "__c")
    b = materialize(b.where(F.col("__left") > 0), "cuts")
    near = materialize(x.join(F.broadcast(b), "__b1"), "near")
    edge = class_rank(near.where(F.col("__left") < F.col("__c")), ["__b1"], order_key, tiebreak, out="__rn", prefix_len=prefix_len + 4)
    kept = near.where(F.col("__left") >= F.col("__c")).unionByName(edge.where(F.col("__rn") <= F.col("__left")).drop("__rn"))
    return kept.drop("__b1", "__left", "__c")


def rows_at_ranks(df: DataFrame, wanted: DataFrame, by: str, order_key: str, tiebreak: str, rank: str = "__rn",
                  prefix_len: int = 4) -> DataFrame:
    """The rows of ``df`` that have the ranks ``wanted(by, rank, ...)``, a written table, in their group, with the columns of ``wanted``.

    Ranks are those of ``class_rank``.  Only the key columns are read for the bucket counts; the wanted
    ranks are placed among the running counts (a window of at most 16**prefix_len buckets and the wanted
    ranks per group), and only the rows of the buckets they fall into are shuffled and ranked.
    """
    from intentloom.operators.joins import MAX_BROADCAST_BYTES, table_bytes
    x = df.withColumn("__b", F.substring(order_key, 1, prefix_len))
    counts = x.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, (F.coalesce(F.sum("__c").over(before), F.lit(0)) + 1).alias(rank), "__b")
    marks = starts.unionByName(wanted.select(by, F.col(rank).cast("long").alias(rank)).distinct(), allowMissingColumns=True)
    so_far = Window.partitionBy(by).orderBy(rank, F.col("__b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("__b").isNotNull(), F.struct("__b", F.col(rank).alias("start"))), ignorenulls=True).over(so_far)
    place = marks.withColumn("__p", at).where(F.col("__b").isNull()).select(
        by, rank, F.col("__p.__b").alias("__b"), (F.col(rank) - F.col("__p.start") + 1).alias("__in"))
    place = materialize(place, "places")
    # one measure for both: the places are the different ranks that are wanted, with a bucket and a number
    small = table_bytes(wanted) + 32 * wanted.count() <= MAX_BROADCAST_BYTES
    hint = F.broadcast if small else (lambda t: t)
    few = x.join(hint(place.select(by, "__b").distinct()), [by, "__b"], "left_semi")
    inside = Window.partitionBy(by, "__b").orderBy(F.col(order_key), F.col(tiebreak))
    hit = few.withColumn("__in", F.row_number().over(inside).cast("long")).join(hint(place), [by, "__b", "__in"])
    return hit.drop("__b", "__in").join(hint(wanted), [by, rank])
