"""Episodes: N classes, K support and Q query rows per class, all episodes in
one job.

* ``episode_classes`` (W12/W15): the label list exploded over the episode ids
  (episodes x labels rows, both parameters/label-sized), top-N per episode by
  seeded hash; ``class_id`` = draw order - 1.
* ``episode_samples`` (W13/W14): every (episode, class) has its own draw without
  replacement, as ranks within the class (``draw_ranks``), so no class is ever
  joined to all its episodes.  Only the rows with those ranks, and their few
  neighbours in the same hash bucket, are shuffled.  Rows repeat only when a class
  has too few (oversampling: each row floor or ceil of m/n times).
* ``episode_pairs`` (J8/J9): query x support inside an episode (bounded by
  N*Q x N*K per episode: parameters, not data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.functions.order import DEFAULT_SEED, hex_to_int, seeded_key
from intentloom.operators.joins import broadcast_written, checked_broadcast
from intentloom.operators.rank import group_top, rows_at_ranks
from intentloom.session import cores, materialize


def episode_classes(labels: DataFrame, episodes: int, n_way: int, extra: int = 0,
                    seed: int = DEFAULT_SEED) -> DataFrame:
    """``(episode, label, class_id)``: ``n_way`` classes per episode (plus
    ``extra`` further ones for a joint target, with class ids n_way...)."""
    x = labels.select("label").distinct().withColumn("episode", F.explode(F.sequence(F.lit(0), F.lit(episodes - 1))))
    x = x.withColumn("__h", seeded_key("episode", "label", salt="ep-class", seed=seed))
    r = group_top(x, ["episode"], [F.col("__h"), F.col("label")], n_way + extra)
    return r.select(F.col("episode").cast("int").alias("episode"), "label",
                    (F.col("rn") - 1).cast("int").alias("class_id"))


def draw_ranks(classes: DataFrame, sizes: DataFrame, m: int, salt: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """``classes`` with ``slot`` 0..m-1 and ``__rn``: for each (episode, label), m ranks out of 1..n drawn at random
    without replacement, in random order; where m >= n, all ranks as often as they fit, and the rest drawn.

    Floyd's sampling, in the row: the i-th of r draws picks from 1..n-r+i, or takes n-r+i itself if its
    pick is taken already; m steps whatever n is.
    """
    n, whole, rest = F.col("__n"), F.floor(F.lit(m) / F.col("__n")), (F.lit(m) % F.col("__n")).cast("long")

    def pick(taken, i):
        top = n - rest + i
        t = F.lit(1) + hex_to_int(seeded_key("episode", "label", i, salt=salt, seed=seed), 15) % top
        return V.let(t, lambda t: F.concat(taken, F.array(F.when(F.array_contains(taken, t), top).otherwise(t))))

    none = F.array().cast("array<bigint>")
    drawn = F.when(rest > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), rest), none, pick)).otherwise(none)
    entry = lambda copy, r: F.struct(seeded_key("episode", "label", copy, r, salt=f"{salt}-order", seed=seed).alias("h"), r.alias("r"))
    copies = F.when(whole > 0, F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), whole), lambda c: F.transform(
        F.sequence(F.lit(1).cast("long"), n), lambda r: entry(c, r))))).otherwise(F.array().cast("array<struct<h:string,r:bigint>>"))
    order = F.array_sort(F.concat(copies, F.transform(drawn, lambda r: entry(F.lit(0).cast("long"), r))))
    return classes.join(sizes, "label").select(*classes.columns, F.posexplode(order).alias("slot", "__e")).select(
        *classes.columns, "slot", F.col("__e.r").alias("__rn"))


def _drawn_rows(rows: DataFrame, classes: DataFrame, m: int, key: str, salt: str, seed: int) -> DataFrame:
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    slots = materialize(draw_ranks(classes, sizes, m, salt, seed), "slots")
    x = rows.withColumn("__h", seeded_key(key, salt="ep-perm", seed=seed))
    return rows_at_ranks(x, slots, "label", "__h", key).drop("__h", "__rn")


def episode_samples(rows: DataFrame, classes: DataFrame, k: int, q: int, key: str = "uid",
                    seed: int = DEFAULT_SEED, queries: DataFrame | None = None, exclude_support: bool = True) -> DataFrame:
    """Rows of every episode: ``(episode, class_id, label, role, slot, <rows cols>)``;
    role 'support' for slots 0..K-1, 'query' for K..K+Q-1.

    Without ``queries`` both roles come from ``rows``, in one draw of K+Q, so that no query row is
    a support row of its episode (unless a class has fewer than K+Q rows); ``exclude_support=False`` draws them
    independently.  With ``queries`` the support is drawn from ``rows`` and the query rows, independently,
    from that table."""
    if queries is None and exclude_support:
        j = _drawn_rows(rows, classes, k + q, key, "ep-draw", seed)
    else:
        sup = _drawn_rows(rows, classes, k, key, "ep-support", seed)
        que = _drawn_rows(rows if queries is None else queries, classes, q, key, "ep-query", seed)
        j = sup.unionByName(que.withColumn("slot", F.col("slot") + F.lit(k)))
    role = F.when(F.col("slot") < k, F.lit("support")).otherwise(F.lit("query"))
    return j.withColumn("role", role).withColumn("slot", F.col("slot").cast("int"))


def episode_pairs(samples: DataFrame, cols=("vec",), written: bool = False) -> DataFrame:
    """Each query row with each support row of its episode, and
    ``same`` = 1 when both have the same class.  ``written``: the samples are a written table, which need not be written again."""
    cols = list(cols)
    q = samples.where(F.col("role") == "query").select(
        "episode", F.col("class_id").alias("q_class"), F.col("slot").alias("q_slot"), F.col("uid").alias("q_uid"),
        *[F.col(c).alias(f"q_{c}") for c in cols])
    s = samples.where(F.col("role") == "support").select(
        "episode", F.col("class_id").alias("s_class"), F.col("slot").alias("s_slot"), F.col("uid").alias("s_uid"),
        *[F.col(c).alias(f"s_{c}") for c in cols])
    # Pair work is compute-heavy and its size is set by the episode parameters
    # (episodes x N*Q x N*K), not by the data: spread the query rows over all
    # cores explicitly (AQE would coalesce the small input into one task) and
    # broadcast the support rows (episodes x N x K, checked).
    q = q.repartition(cores(samples.sparkSession), "episode", "q_class", "q_slot")
    return q.join(broadcast_written(s) if written else checked_broadcast(s), "episode").withColumn("same", (F.col("q_class") == F.col("s_class")).cast("int"))
