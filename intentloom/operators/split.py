"""Splits and samples: seeded shuffle, ratio split, K-shot support, test/support
unions, class moves, positional slices, and the split audit.

All of them rank rows of a class in seeded-hash order with
``rank.class_rank`` (skew-safe, exact) or ``rank.group_top`` (top-K with a
partial limit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.functions.order import DEFAULT_SEED, seeded_key
from intentloom.operators.joins import counted, sized_broadcast
from intentloom.operators.rank import class_rank, global_rank, group_top

DATA_PARTS = ("train_seen", "test_seen", "test_novel")
SUPPORT_PARTS = ("support_novel", "support_seen")


def shuffle_rank(df: DataFrame, by: str = "label", key: str = "uid", salt: str = "split",
                 seed: int = DEFAULT_SEED, out: str = "rn", total: str | None = "n") -> DataFrame:
    """1-based rank of each row inside its class in seeded random order."""
    x = df.withColumn("__h", seeded_key(key, salt=salt, seed=seed))
    return class_rank(x, [by] if by else [], "__h", key, out=out, total=total).drop("__h")


def train_size(n, num: int = 2, den: int = 3):
    """``int(num * n / den)`` computed exactly as integer division."""
    return F.floor((n * F.lit(num)).cast("double") / F.lit(float(den))).cast("long")


def ratio_split(df: DataFrame, num: int = 2, den: int = 3, seed: int = DEFAULT_SEED,
                label: str = "label") -> DataFrame:
    """Per class, the first ``(num*n) div den`` rows of the shuffle are
    'train', the rest 'test'.  Adds ``part``, ``rn``, ``n``."""
    r = shuffle_rank(df, by=label, seed=seed)
    t = train_size(F.col("n"), num, den)
    return r.withColumn("part", F.when(F.col("rn") <= t, F.lit("train")).otherwise(F.lit("test")))


def kshot_support(df: DataFrame, k: int, label: str = "label", key: str = "uid",
                  salt: str = "shot", seed: int = DEFAULT_SEED) -> DataFrame:
    """K random rows per class (all rows when a class has fewer)."""
    x = df.withColumn("__h", seeded_key(key, salt=salt, seed=seed))
    return group_top(x, [label], [F.col("__h"), F.col(key)], k).drop("__h")


def split_sets(utts: DataFrame, roles: DataFrame, shots=(1, 5), num: int = 2, den: int = 3,
               seed: int = DEFAULT_SEED, keep_rank: bool = False, n_labels: int | None = None) -> DataFrame:
    """Build every part of a few-shot split in one pass.

    ``utts``: canonical utterances (deduplicated); ``roles``: ``(label, role)``
    with role 'seen' or 'novel'.  Per class the rows are shuffled once; the
    first ``(num*n) div den`` are the train part.  Output rows carry ``part`` and
    ``k`` (0 for data parts):

    * seen:  train -> train_seen, rest -> test_seen
    * novel: rest -> test_novel (their remaining train rows go nowhere)
    * every K in ``shots``: the first ``least(K, train)`` rows of the train
      part -> support_seen / support_novel, so supports nest as K grows.

    One shuffle ranks the rows; one ``explode`` emits the parts, so the source
    is read once.  test_joint and support_joint are unions of parts (see
    ``test_joint`` / ``support_joint``).
    """
    if n_labels is None:
        roles, n_labels = counted(roles.select("label", "role"))
    d = utts.join(sized_broadcast(roles.select("label", "role"), n_labels), "label")
    shots = [int(k) for k in shots]
    # One bucketed rank per class (a single shuffle of the deduplicated rows,
    # skew-safe).  Ranking only the rows near the cut points (rank_cuts) was
    # measured slower here: its branches re-read the deduplicated table.
    r = shuffle_rank(d, by="label", seed=seed)
    t = train_size(F.col("n"), num, den)
    r = r.withColumn("__tr", F.col("rn") <= t)
    for k in shots:
        r = r.withColumn(f"__s{k}", F.col("rn") <= F.least(F.lit(k).cast("long"), t))
    ks = F.array(F.lit(0), *[F.lit(k) for k in shots])
    flags = F.array(F.col("__tr"), *[F.col(f"__s{k}") for k in shots])
    x = r.select("*", F.posexplode(ks).alias("__i", "k")).withColumn("__f", F.element_at(flags, F.col("__i") + 1))
    is_train = F.col("__tr")
    part = (F.when(F.col("k") == 0,
                   F.when(F.col("role") == "seen",
                          F.when(is_train, F.lit("train_seen")).otherwise(F.lit("test_seen")))
                   .otherwise(F.when(~is_train, F.lit("test_novel"))))
            .otherwise(F.when(F.col("__f"), F.concat(F.lit("support_"), F.col("role")))))
    extra = [F.col("rn"), train_size(F.col("n"), num, den).alias("train_n")] if keep_rank else []
    return (x.withColumn("part", part).where(F.col("part").isNotNull())
            .select("uid", "utterance", "label", "ord", "role", "part", F.col("k").cast("int").alias("k"), *extra))


def test_joint(split: DataFrame) -> DataFrame:
    """test_joint = test_seen + test_novel (bag union of two parts)."""
    return split.where(F.col("part").isin("test_seen", "test_novel"))


def support_joint(split: DataFrame, k: int) -> DataFrame:
    """support_joint = support_novel + support_seen for one K."""
    return split.where(F.col("part").isin(*SUPPORT_PARTS) & (F.col("k") == k))


def eval_scope(split: DataFrame, scope: str = "joint", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(test rows, support rows) for 'joint' (generalized), 'novel' (tgt)
    or 'seen' (src).  Filters on ``part``/``k`` prune partitions of a sink."""
    if scope == "joint":
        return test_joint(split), support_joint(split, k)
    if scope == "novel":
        return (split.where(F.col("part") == "test_novel"),
                split.where((F.col("part") == "support_novel") & (F.col("k") == k)))
    if scope == "seen":
        return (split.where(F.col("part") == "test_seen"),
                split.where((F.col("part") == "support_seen") & (F.col("k") == k)))
    raise ValueError(f"unknown scope {scope!r}")


def reassign_class(split: DataFrame, moved: DataFrame) -> DataFrame:
    """move labels from seen to novel across the parts.

    Rows of a moved label leave train_seen; their test_seen rows become
    test_novel and their support_seen rows become support_novel (test_joint and
    support_joint keep the same rows).
    """
    m = moved.select("label").distinct().withColumn("__moved", F.lit(True))
    j = split.join(m, "label", "left")
    mv = F.col("__moved").isNotNull()
    part = (F.when(mv & (F.col("part") == "train_seen"), F.lit(None))
            .when(mv & (F.col("part") == "test_seen"), F.lit("test_novel"))
            .when(mv & (F.col("part") == "support_seen"), F.lit("support_novel"))
            .otherwise(F.col("part")))
    return (j.withColumn("part", part).withColumn("role", F.when(mv, F.lit("novel")).otherwise(F.col("role")))
            .where(F.col("part").isNotNull()).drop("__moved"))


def position_slice(df: DataFrame, start: int, stop: int | None = None, order: str = "ord") -> DataFrame:
    """rows at positions [start, stop) of the ``order`` column (0-based),
    like ``df[start:stop]`` on an ordered frame; adds ``pos``."""
    r = global_rank(df, [F.col(order)], out="pos").withColumn("pos", F.col("pos") - 1)
    cond = F.col("pos") >= start
    if stop is not None:
        cond = cond & (F.col("pos") < stop)
    return r.where(cond)


def splice(base: DataFrame, insert: DataFrame, at: int, order: str = "ord") -> DataFrame:
    """``concat([base[:at], insert, base[at:]])`` as new 0-based ``pos``."""
    b = global_rank(base, [F.col(order)], out="__p").withColumn("__p", F.col("__p") - 1)
    i = global_rank(insert, [F.col(order)], out="__p").withColumn("__p", F.col("__p") - 1)
    n_ins = insert.select(F.count(F.lit(1))).scalar()
    b = b.withColumn("pos", F.when(F.col("__p") < at, F.col("__p")).otherwise(F.col("__p") + n_ins))
    i = i.withColumn("pos", F.col("__p") + F.lit(at))
    return b.drop("__p").unionByName(i.drop("__p"))


def validation_slice(df: DataFrame, den: int = 9, order: str = "ord", held_out: bool = False,
                     key: str = "uid", seed: int = DEFAULT_SEED) -> DataFrame:
    """The first ``n div den`` rows (by ``order``) are 'valid', the rest
    'train' (the reference validates on a leading slice of its train rows).
    With ``held_out=True`` the validation rows are a seeded random draw of
    the same size instead of the leading slice."""
    n = df.select(F.count(F.lit(1))).scalar()
    if held_out:
        x = df.withColumn("__h", seeded_key(key, salt="valid", seed=seed))
        r = class_rank(x, [], "__h", key, out="pos").drop("__h")
    else:
        r = global_rank(df, [F.col(order)], out="pos")
    lim = F.floor(n.cast("double") / F.lit(float(den))).cast("long")
    return r.withColumn("part", F.when(F.col("pos") <= lim, F.lit("valid")).otherwise(F.lit("train")))


def split_audit(split: DataFrame, roles: DataFrame, shots=(1, 5), strict: bool = False) -> DataFrame:
    """Per label and part: rows, distinct texts, rows whose text also occurs
    in another part of the same label set, and K-shortfall of supports.

    Returns ``(label, part, k, n, short)``; ``short`` = K - n for supports with
    fewer than K rows (the reference would raise there).  With ``strict=True`` a
    shortfall raises ``ValueError`` (one small aggregate is collected).
    """
    cnt = split.groupBy("label", "part", "k").agg(F.count(F.lit(1)).alias("n"))
    # labels that ended up without rows (e.g. every text taken by another label)
    empty = roles.select("label").join(split.select("label").distinct(), "label", "left_anti")
    sup = (roles.select("label", "role")
           .withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in shots])))
           .withColumn("part", F.concat(F.lit("support_"), F.col("role"))).drop("role"))
    full = sup.join(cnt, ["label", "part", "k"], "left").select(
        "label", "part", "k", F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    data = cnt.where(F.col("k") == 0)
    out = full.unionByName(data).withColumn(
        "short", F.when(F.col("k") > 0, F.greatest(F.col("k") - F.col("n"), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("empty_label", F.lit(False)).unionByName(
        empty.select("label", F.lit("none").alias("part"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"),
                     F.lit(0).cast("long").alias("short"), F.lit(True).alias("empty_label")))
    if strict:
        bad = out.where(F.col("short") > 0).limit(1).collect()
        if bad:
            raise ValueError(f"support short of K: {bad[0].asDict()}")
    return out


def cross_part_texts(split: DataFrame, a: str, b: str) -> DataFrame:
    """E7 leak check: texts present in both part ``a`` and part ``b`` (inner join
    of the two parts' distinct texts)."""
    x = split.where(F.col("part") == a).select("utterance").distinct()
    y = split.where(F.col("part") == b).select("utterance").distinct()
    return x.join(y, "utterance")
