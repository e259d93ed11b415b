"""Exact nearest candidates over large label sets: pivots, balls and the triangle inequality.

The candidates of a scope are dealt to the nearest of about sqrt(n) pivots (a hashed sample of themselves), and each
pivot's candidates to *balls* of at most ``BALL`` with their own radius.  A query measures its distance to the
pivots only: no candidate of a ball can be nearer than (distance to the pivot - radius).  Balls are visited in the
order of that bound, and as soon as it exceeds the best found the rest is skipped.  The answer is that of the full
scan, ties included; how much is skipped depends on how clustered the candidates are, and is reported.

Cosine is searched in the same way on unit vectors, where cos = 1 - chord^2 / 2 falls with the distance.

Balls travel like other candidates: in blocks of bounded bytes, per scope, one pass over the queries per block.  From
block to block a query keeps its best, so balls of later blocks are skipped against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.functions.order import hash_int
from intentloom.operators.joins import candidate_blocks, with_block
from intentloom.operators.rank import null_safe_join
from intentloom.session import materialize

BALL = 64       # candidates of a ball
NO_ORDER = float("-inf")  # an order that is null comes first, as in a scan's comparison of structs
SLACK = 1e-7    # above the errors of rounded distances: nothing that ties with the best is skipped


def unit(a) -> Column:
    """The vector at length 1 (null where it has none)."""
    return V.let(V.norm(a), lambda n: F.when(n > 0, F.transform(V._c(a), lambda x: x.cast("double") / n)))


def balls(cands: DataFrame, scope_col: str, point: str) -> DataFrame:
    """``cands(scope_col, label, point, ...)`` -> one row per ball: scope_col, pivot, radius, members (the candidates).

    Candidates without a point lie in balls without a pivot, which no bound ever skips."""
    from intentloom.operators.score import nearest_prototype
    c = materialize(cands, "candidates")
    sizes = c.where(F.col(point).isNotNull()).groupBy(scope_col).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("__m"))
    # one in sqrt(n) by a hash: pivots only steer the search, any choice is right
    drawn = null_safe_join(c.where(F.col(point).isNotNull()), sizes, [scope_col]).where(hash_int("label") % F.col("__m") == 0)
    some = materialize(drawn.select(scope_col, F.col("label").alias("__pl"), F.col(point).alias("__pv")), "pivots")
    near = nearest_prototype(c, some.select(scope_col, F.col("__pl").alias("label"), F.col("__pv").alias("proto")), scope_col=scope_col,
                             key="label", vec=point, carry=[x for x in c.columns if x not in ("label", scope_col, point)] + [scope_col, point])
    far = F.when(F.col(point).isNotNull(), F.col("score"))
    near = near.withColumn("__pl", F.when(F.col(point).isNotNull(), F.col("pred"))).withColumn("__far", far)
    near = materialize(near.drop("pred", "score"), "dealt")
    each = near.groupBy(scope_col, "__pl").agg(F.ceil(F.count(F.lit(1)) / BALL).alias("__parts"))
    parts = null_safe_join(near, each, [scope_col, "__pl"]).withColumn("__part", F.pmod(F.xxhash64("label"), F.col("__parts")))
    found = parts.groupBy(scope_col, "__pl", "__part").agg(F.max("__far").alias("radius"), F.collect_list(F.struct(*c.columns)).alias("members"))
    return null_safe_join(found, some, [scope_col, "__pl"], "left").select(scope_col, F.col("__pv").alias("pivot"), "radius", "members")


def nearest(queries: DataFrame, cands: DataFrame, order_of, floor_of, scope_col: str = "scope", key: str = "uid", vec: str = "vec",
            point: Column | None = None, cand_point: str = "__p", carry=(), block_bytes: int | None = None) -> DataFrame:
    """The candidate of least ``order_of(candidate)``, ties to the lowest label, of each query's scope.

    ``point`` and ``cand_point`` are the query's and the candidates' places in the metric space, and ``floor_of(d)`` the
    least order that a candidate at distance ``d`` or more can have.  Returns ``(key, carry..., pred, order, visited,
    balls)``: balls whose candidates were measured, of those there were."""
    carry = [c for c in carry if c != key]
    point = F.col(vec) if point is None else point
    rows = queries.select(*dict.fromkeys([key, *carry, scope_col, vec])).withColumn("__q", point)
    none = F.struct(F.lit(float("inf")).alias("o"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("visited"), F.lit(0).alias("balls"))
    rows = rows.withColumn("__best", none)
    for i, block in enumerate(candidate_blocks(balls(cands, scope_col, cand_point), [scope_col, "pivot", "radius", "members"], block_bytes, scope_col)):
        if i:
            rows = materialize(rows)
        own = F.filter(F.coalesce("__cands", F.array().cast(block.schema["__arr"].dataType)), lambda b: b[scope_col] == F.col(scope_col))
        least = lambda b: floor_of(F.coalesce(F.greatest(V.l2_dist(F.col("__q"), b["pivot"]) - b["radius"], F.lit(0.0)), F.lit(0.0)))

        def search(found):
            """The best after the balls ``found``, from the best so far."""
            def visit(best, n):
                here = F.array_min(F.transform(F.get(found, n)["members"], lambda c: F.struct(F.coalesce(order_of(c), F.lit(NO_ORDER)).alias("o"), c["label"].alias("label"))))
                return V.let(F.least(F.struct(best["o"].alias("o"), best["label"].alias("label")), here), lambda m: F.struct(
                    m["o"].alias("o"), m["label"].alias("label"), (best["visited"] + 1).alias("visited"), best["balls"].alias("balls")))

            start = F.struct(*(F.col(f"__best.{c}").alias(c) for c in ("o", "label", "visited")), (F.col("__best.balls") + F.size(found)).alias("balls"))
            order = F.array_sort(F.transform(found, lambda b, n: F.struct(least(b).alias("floor"), n.alias("n"))))
            return F.aggregate(order, start, lambda best, b: F.when(
                b["floor"] > best["o"] + SLACK * (1 + F.abs(best["o"])), best).otherwise(visit(best, b["n"])))

        rows = with_block(rows, block, scope_col).withColumn("__best", V.let(own, search)).drop("__cands")
    got = F.col("__best.label").isNotNull() & (F.col("__best.o") != F.lit(NO_ORDER))
    return rows.select(key, *carry, F.col("__best.label").alias("pred"), F.when(got, F.col("__best.o")).alias("order"),
                       F.col("__best.visited").alias("visited"), F.col("__best.balls").alias("balls"))
