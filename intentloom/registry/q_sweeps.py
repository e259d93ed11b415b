"""Proofs for the three sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.operators import labels as L
from intentloom.operators import split as S
from intentloom.operators import sweeps as W
from intentloom.plans import split_build
from intentloom.registry import query
from intentloom.registry.sqlparts import DEDUP, RANKED, ROLES, SPLIT, UTT, VEC
from intentloom.session import materialize
from intentloom.sources import views


@query("w8_seen_fraction_sweep", sql=f"""
with sp as ({SPLIT(UTT)}),
rk as (select uid, rn, floor(CAST(n * 2 AS DOUBLE) / 3.0) as tt from ({RANKED(f"select d.* from ({DEDUP(UTT)}) d")}))
select CAST(p.pct AS INTEGER) as pct, sp.uid, sp.label, sp.part, sp.k
from sp join rk using (uid), (select unnest([20, 40, 60, 80, 100]) as pct) p
where sp.part <> 'train_seen' or rk.rn <= floor(CAST(p.pct * rk.tt AS DOUBLE) / 100.0)
""")
def w8_seen_fraction_sweep(spark, d):
    u = views.utt(spark, d)
    roles = split_build.roles_of(u)
    sp = S.split_sets(L.dedup_last_wins(u), roles, keep_rank=True)
    return W.seen_fraction_sweep(sp).select(F.col("pct").cast("int").alias("pct"), "uid", "label", "part", "k")


LS_STEPS = f"""
roles as ({ROLES(UTT, 33)}),
ranked as (select label, role, case when role = 'seen' then row_number() over (partition by role order by label)
                                    else novel_rank end as r,
                  count(*) over (partition by role) as n_role from roles),
steps as (select p.pct, label from ranked, (select unnest(range(10, 110, 10)) as pct) p
          where r <= floor(CAST(p.pct * n_role AS DOUBLE) / 100.0))
"""


@query("w10_label_space_sweep", sql=f"""
with sp as ({SPLIT(UTT)}), {LS_STEPS}
select CAST(steps.pct AS INTEGER) as pct, sp.uid, sp.label, sp.part, sp.k from sp join steps using (label)
""")
def w10_label_space_sweep(spark, d):
    sp, roles = split_build.build(views.utt(spark, d))
    return W.label_space_sweep(sp, roles).select(F.col("pct").cast("int").alias("pct"), "uid", "label", "part", "k")


def _accuracy_sql(steps: str, protos: str, queries: str) -> str:
    """Accuracy per step: ``protos(step, label, proto)`` against ``queries(step, uid, label, vec)``."""
    return f"""
with {steps} p as ({protos}), q as ({queries}),
best as (select q.step, q.uid, q.label, arg_min(p.label, struct_pack(d := round(list_distance(CAST(q.vec AS DOUBLE[]), p.proto), 9), c := p.label)) as pred
         from q join p using (step) group by q.step, q.uid, q.label)
select CAST(step AS INTEGER) as step, round(avg(CAST(label = pred AS DOUBLE)), 6) as acc, count(*) as n from best group by step
"""


def _mean_sql(rows: str) -> str:
    return (f"select step, label, list(x order by dim) as proto from (select step, label, dim, avg(x) as x from ("
            f"select step, label, unnest(range(len(vec))) as dim, CAST(unnest(vec) AS DOUBLE) as x from ({rows})) group by step, label, dim) group by step, label")


VEC_RANKED = f"select uid, label, vec, rn, n, floor(CAST(n * 2 AS DOUBLE) / 3.0) as tt from ({RANKED(VEC)})"


def vec_ranked(spark, d):
    """Vectors with their rank in the split order of their class, and the size of the class's train part."""
    from intentloom.functions.order import seeded_key
    from intentloom.operators.rank import class_rank
    x = views.vec(spark, d).withColumn("h", seeded_key("uid", salt="split"))
    return class_rank(x, ["label"], "h", "uid", "rn", total="n").withColumn("tt", F.floor((F.col("n") * 2).cast("double") / 3.0))


SHOTS = (1, 5, 10, 20)


@query("w11_shots_accuracy", sql=_accuracy_sql(
    f"r as ({VEC_RANKED}), s as (select unnest([1, 5, 10, 20]) as step),",
    _mean_sql("select step, label, vec from r join s on rn <= step and rn <= tt"), "select step, uid, label, vec from r, s where rn > tt"))
def w11_shots_accuracy(spark, d):
    """Test accuracy for every K: nested supports as prefix sums, one scan of the test rows."""
    r = materialize(vec_ranked(spark, d), "ranked")
    protos = W.step_prototypes(r.where("rn <= tt"), [(k, k) for k in SHOTS])
    return _rounded(W.step_accuracy(r.where("rn > tt").select("uid", "label", "vec"), protos, SHOTS))


def _rounded(acc):
    return acc.select(F.col("step").cast("int").alias("step"), F.round("acc", 6).alias("acc"), "n")


@query("w8_fraction_accuracy", sql=_accuracy_sql(
    f"r as ({VEC_RANKED}), s as (select unnest([20, 40, 60, 80, 100]) as step),",
    _mean_sql("select step, label, vec from r join s on rn <= floor(CAST(step * tt AS DOUBLE) / 100.0)"), "select step, uid, label, vec from r, s where rn > tt"))
def w8_fraction_accuracy(spark, d):
    """Test accuracy for every share of the train rows."""
    r = materialize(vec_ranked(spark, d), "ranked")
    limit = lambda p: F.floor((F.lit(p) * F.col("tt")).cast("double") / 100.0)
    protos = W.step_prototypes(r.where("rn <= tt"), [(p, limit(p)) for p in W.SEEN_FRACTION_STEPS])
    return _rounded(W.step_accuracy(r.where("rn > tt").select("uid", "label", "vec"), protos, W.SEEN_FRACTION_STEPS))


@query("w10_label_space_accuracy", sql=_accuracy_sql(
    f"r as ({VEC_RANKED}), {LS_STEPS.replace(ROLES(UTT, 33), ROLES(VEC, 33))}, s as (select pct as step, label from steps),",
    _mean_sql("select step, label, vec from r join s using (label) where rn <= 5 and rn <= tt"), "select step, uid, label, vec from r join s using (label) where rn > tt"))
def w10_label_space_accuracy(spark, d):
    """Test accuracy over every step's label space: each step's own labels, with the same 5-shot prototypes."""
    r = materialize(vec_ranked(spark, d), "ranked")
    steps = F.broadcast(materialize(W.label_space_steps(L.choose_novel(r.select("label").distinct(), pct=33)), "steps").withColumnRenamed("pct", "step"))  # labels x steps
    protos = W.step_prototypes(r.where("rn <= tt"), [(5, 5)]).drop("step").join(steps, "label")
    queries = r.where("rn > tt").select("uid", "label", "vec").join(steps, "label")
    return _rounded(W.step_accuracy(queries, protos, W.LABEL_SPACE_STEPS))


@query("w11_shots_sweep", sql=f"""
select uid, label, part, k from ({SPLIT(UTT, shots=(1, 5, 10, 20))})
""")
def w11_shots_sweep(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), shots=W.SHOT_STEPS)
    return W.shots_sweep(sp).select("uid", "label", "part", "k")
