"""Proofs for episodes, episodic evaluation and head matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.functions import vectors as V
from intentloom.functions.order import hash_int
from intentloom.operators import episodes as EP
from intentloom.operators import evaluate as E
from intentloom.operators import match_kernel as MK
from intentloom.operators import matching as M
from intentloom.operators import score as SC
from intentloom.plans import episodic
from intentloom.registry import query
from intentloom.registry.sqlparts import DCOS, DFLOOR, EPISODES, HINT, VEC, VEC_HEADS
from intentloom.session import materialize
from intentloom.sources import views

EPS20 = EPISODES(VEC, 20, 5, 5, 5)


@query("w12_episode_classes", sql=f"""
select distinct episode, label, class_id from ({EPS20})
""")
def w12_episode_classes(spark, d):
    return EP.episode_classes(views.vec(spark, d).select("label"), 20, 5)


@query("w13_episode_samples", sql=f"select episode, class_id, slot, role, uid from ({EPS20})")
def w13_episode_samples(spark, d):
    return episodic.samples(views.vec(spark, d)).select("episode", "class_id", "slot", "role", "uid")


@query("w12_joint_classes", sql=f"select distinct episode, label, class_id from ({EPISODES(VEC, 20, 8, 5, 5)})")
def w12_joint_classes(spark, d):
    """Joint target: as many further classes as there are in the episode (4 and 4 of the 10 labels)."""
    return episodic.samples(views.vec(spark, d), n_way=4, extra=4).select("episode", "label", "class_id").distinct()


HALVES = {h: f"select * from ({VEC}) where {HINT('uid')} % 2 = {i}" for i, h in enumerate(("support", "query"))}


@query("w13_two_tables", sql=f"""
select episode, class_id, slot, role, uid from ({EPISODES(HALVES['support'], 20, 5, 5, 7, queries=HALVES['query'])})
""")
def w13_two_tables(spark, d):
    """Support rows from one half of the table, query rows from the other, drawn independently."""
    v = views.vec(spark, d)
    smp = episodic.samples(v.where(hash_int("uid") % 2 == 0), q=7, queries=v.where(hash_int("uid") % 2 == 1))
    return smp.select("episode", "class_id", "slot", "role", "uid")


@query("w13_with_overlap", sql=f"""
select episode, class_id, slot, role, uid from ({EPISODES(VEC, 20, 5, 5, 5, apart=False)})
""")
def w13_with_overlap(spark, d):
    """Both roles drawn independently from the same rows."""
    return episodic.samples(views.vec(spark, d), exclude_support=False).select("episode", "class_id", "slot", "role", "uid")


@query("w14_oversample", sql=f"""
select episode, class_id, uid, count(*) as copies from ({EPISODES(VEC, 4, 3, 5, 60)}) group by all
""")
def w14_oversample(spark, d):
    s = episodic.samples(views.vec(spark, d), episodes=4, n_way=3, k=5, q=60)
    return s.groupBy("episode", "class_id", "uid").agg(F.count(F.lit(1)).alias("copies"))


PROTO_EP = f"""
smp as ({EPS20}),
pe as (select episode, class_id, dim, avg(x) as x from (select episode, class_id, unnest(range(len(vec))) as dim,
       CAST(unnest(vec) AS DOUBLE) as x from smp where role = 'support') group by all),
p as (select episode, class_id, list(x order by dim) as proto from pe group by episode, class_id),
q as (select episode, class_id as q_class, CAST(class_id AS BIGINT) * 4294967296 + slot as qkey, CAST(vec AS DOUBLE[]) as vec from smp where role = 'query')
"""


@query("e3_episodic_eval", sql=f"""
with {PROTO_EP},
pr as (select q.episode, q.qkey, q.q_class,
              arg_min(p.class_id, struct_pack(l := -round(-list_reduce(list_transform(list_zip(q.vec, p.proto), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b), 9), c := p.class_id)) as pred
       from q join p using (episode) group by all),
acc as (select episode, avg(CAST(pred = q_class AS DOUBLE)) as acc from pr group by episode)
select round(avg(acc), 6) as mean, round(stddev_pop(acc), 6) as std, count(*) as count from acc
""")
def e3_episodic_eval(spark, d):
    acc = episodic.episode_accuracy(episodic.samples(views.vec(spark, d)))
    return E.mean_std(acc, "acc")


W7 = [1.0 / (1 + i) for i in range(64)]


@query("x7_weighted_sqdist", sql=f"""
with {PROTO_EP},
w as (select [{', '.join(repr(x) for x in W7)}]::DOUBLE[] as w)
select q.episode, q.qkey, q.q_class,
       arg_min(p.class_id, struct_pack(l := -round(-list_sum(list_transform(range(64), lambda i: w.w[i + 1] * (q.vec[i + 1] - p.proto[i + 1]) * (q.vec[i + 1] - p.proto[i + 1]))), 9), c := p.class_id)) as pred,
       round(max(round(-list_sum(list_transform(range(64), lambda i: w.w[i + 1] * (q.vec[i + 1] - p.proto[i + 1]) * (q.vec[i + 1] - p.proto[i + 1]))), 9)), 6) as logit
from q join p using (episode), w group by all
""")
def x7_weighted_sqdist(spark, d):
    pr = episodic.episode_predictions(episodic.samples(views.vec(spark, d)), weights=W7)
    return pr.select("episode", "qkey", "q_class", "pred", F.round("logit", 6).alias("logit"))


@query("a15_dispersion", sql=f"""
with {PROTO_EP}
select s.episode, s.class_id, round(avg(list_reduce(list_transform(list_zip(CAST(s.vec AS DOUBLE[]), p.proto), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)), 6) as dispersion
from smp s join p using (episode, class_id) where s.role = 'support' group by all
""")
def a15_dispersion(spark, d):
    smp = episodic.samples(views.vec(spark, d))
    sup = smp.where(F.col("role") == "support")
    protos = SC.prototypes(sup, by=("episode", "class_id"))
    out = SC.dispersion(sup, protos, by=("episode", "class_id"))
    return out.select("episode", "class_id", F.round("dispersion", 6).alias("dispersion"))


@query("x21_attn_prototype", sql=f"""
with smp as ({EPS20}),
q as (select episode, CAST(class_id AS BIGINT) * 4294967296 + slot as qkey, CAST(vec AS DOUBLE[]) as qv from smp where role = 'query'),
s as (select episode, class_id, slot, CAST(vec AS DOUBLE[]) as sv from smp where role = 'support'),
j as (select q.episode, q.qkey, s.class_id, s.sv,
             list_sum(list_transform(list_zip(s.sv, q.qv), lambda z: tanh(z[1] * z[2]))) as a from q join s using (episode)),
w as (select *, exp(a - max(a) over (partition by episode, qkey, class_id)) as e from j),
w2 as (select *, e / sum(e) over (partition by episode, qkey, class_id) as wt from w),
x as (select episode, qkey, class_id, unnest(range(len(sv))) as dim, wt * unnest(sv) as val from w2),
g as (select episode, qkey, class_id, dim, sum(val) as v from x group by all)
select episode, qkey, class_id, round(sum(v), 6) as proto_sum, round(sqrt(sum(v * v)), 6) as proto_norm from g group by all
""")
def x21_attn_prototype(spark, d):
    smp = episodic.samples(views.vec(spark, d))
    q = smp.where(F.col("role") == "query").select("episode", episodic.query_key().alias("qkey"), "vec")
    s = smp.where(F.col("role") == "support").select("episode", "class_id", "uid", "vec")
    out = SC.attentive_prototypes(q, s, by=("episode", "class_id"), qkey="qkey")
    return out.select("episode", "qkey", "class_id", F.round(V.vsum("proto"), 6).alias("proto_sum"),
                      F.round(V.norm("proto"), 6).alias("proto_norm"))


@query("j8_episode_pairs", sql=f"""
with smp as ({EPS20}),
q as (select episode, class_id as q_class, slot as q_slot, uid as q_uid from smp where role = 'query'),
s as (select episode, class_id as s_class, slot as s_slot, uid as s_uid from smp where role = 'support')
select q.*, s.s_class, s.s_slot, s.s_uid, CAST(q_class = s_class AS INTEGER) as same from q join s using (episode)
""")
def j8_episode_pairs(spark, d):
    smp = episodic.samples(views.vec(spark, d))
    return EP.episode_pairs(smp, cols=()).select(
        "episode", "q_class", "q_slot", "q_uid", "s_class", "s_slot", "s_uid", "same")


HEAD_PAIRS = f"""
smp as ({EPISODES(VEC_HEADS, 20, 5, 5, 5, cols='uid, heads')}),
pr as (select q.episode, q.class_id as q_class, q.slot as q_slot, s.class_id as s_class, s.slot as s_slot,
              q.heads as B, s.heads as A
       from (select * from smp where role = 'query') q join (select * from smp where role = 'support') s using (episode))
"""

KEYS = "episode, q_class, q_slot, s_class, s_slot"


def head_pairs(spark, d):
    smp = episodic.samples(views.vec_heads(spark, d).withColumnRenamed("heads", "vec"))
    return EP.episode_pairs(smp, cols=("vec",), written=True).withColumnRenamed("s_vec", "A").withColumnRenamed("q_vec", "B")


@query("x19_maxsim", sql=f"""
with {HEAD_PAIRS}
select {KEYS},
  round(list_avg(list_transform(A, lambda a: list_max(list_transform(B, lambda b: {DCOS('a', 'b')})))), 6) as maxsim_s,
  round(list_avg(list_transform(B, lambda b: list_max(list_transform(A, lambda a: {DCOS('b', 'a')})))), 6) as maxsim_q
from pr
""")
def x19_maxsim(spark, d):
    return matched(head_pairs(spark, d), {"maxsim_s": ("maxsim_s", None), "maxsim_q": ("maxsim_q", None)})


def matched(pairs, scores):
    """Rounded kernel scores of each pair."""
    s = MK.match_scores(pairs, KEYS.split(", "), scores)
    return s.select(*KEYS.split(", "), *(F.round(n, 6).alias(n) for n in scores))


ATT_MEAN = ("list_transform(range(16), lambda k: list_sum(list_transform(B, lambda b: {cab} * b[k + 1])) / "
            + DFLOOR("list_sum(list_transform(B, lambda b: {cab}))") + ")").format(cab=DCOS("a", "b"))


@query("x18_soft_align", sql=f"""
with {HEAD_PAIRS}
select {KEYS},
  round(list_avg(list_transform(A, lambda a: {DCOS('a', ATT_MEAN)})), 6) as soft_align
from pr
""")
def x18_soft_align(spark, d):
    return matched(head_pairs(spark, d), {"soft_align": ("soft_align", None)})


@query("x18_soft_align_columns", sql=f"""
select {KEYS},
  round(list_avg(list_transform(A, lambda a: {DCOS('a', ATT_MEAN)})), 6) as soft_align
from (with {HEAD_PAIRS} select * from pr)
""")
def x18_soft_align_columns(spark, d):
    """The same as column expressions, for plans that must not leave the JVM."""
    p = M.with_alignment(head_pairs(spark, d))
    return p.select(*KEYS.split(", "), F.round(M.soft_align(), 6).alias("soft_align"))


W_P0 = [1.0] * 16
W_P1 = [(k + 1) / 16.0 for k in range(16)]
MAXATT = "list_transform(range(16), lambda k: list_max(list_transform(B, lambda b: {cab} * b[k + 1])))".format(
    cab=DCOS("a", "b"))


def _hw(w):
    wl = "(CAST([" + ", ".join(repr(x) for x in w) + "] AS DOUBLE[]))"
    wa = f"list_transform(range(16), lambda k: A[i + 1][k + 1] * {wl}[k + 1])"
    wb = f"list_transform(range(16), lambda k: B[i + 1][k + 1] * {wl}[k + 1])"
    return f"list_avg(list_transform(range(4), lambda i: {DCOS(wa, wb)}))"


@query("x20_multi_perspective", sql=f"""
with {HEAD_PAIRS}
select {KEYS},
  round({_hw(W_P0)}, 6) as headwise_p0,
  round({_hw(W_P1)}, 6) as headwise_p1,
  round(list_avg(list_transform(A, lambda a: {DCOS('a', MAXATT)})), 6) as max_attentive
from pr
""")
def x20_multi_perspective(spark, d):
    return matched(head_pairs(spark, d), {"headwise_p0": ("headwise", W_P0), "headwise_p1": ("headwise", W_P1), "max_attentive": ("max_attentive", None)})


def _wt(rows):
    return f"list_transform({rows}, lambda r: list_transform(range(16), lambda k: r[k + 1] * (k + 1) / 16.0))"


@query("x20_weighted_matches", sql=f"""
with {HEAD_PAIRS},
al as (select *, list_transform(A, lambda a: {ATT_MEAN}) as S, list_transform(A, lambda a: {MAXATT}) as M from pr),
wt as (select {KEYS}, {_wt('A')} as A, {_wt('B')} as B, {_wt('S')} as S, {_wt('M')} as M from al)
select {KEYS},
  round(list_avg(list_transform(A, lambda a: list_max(list_transform(B, lambda b: {DCOS('a', 'b')})))), 6) as maxpool_p1,
  round(list_avg(list_transform(range(4), lambda i: {DCOS('A[i + 1]', 'S[i + 1]')})), 6) as soft_p1,
  round(list_avg(list_transform(range(4), lambda i: {DCOS('A[i + 1]', 'M[i + 1]')})), 6) as max_attentive_p1
from wt
""")
def x20_weighted_matches(spark, d):
    """One weighted perspective on the max-pool, soft and max-attentive matches."""
    return matched(head_pairs(spark, d), {"maxpool_p1": ("maxpool", W_P1), "soft_p1": ("soft_align", W_P1), "max_attentive_p1": ("max_attentive", W_P1)})


KL = """
list_sum(list_transform(list_zip(
   list_transform(ps, lambda x: (case when x <> 0 then exp(x - list_max(ps)) else 0 end) /
        (case when list_sum(list_transform(ps, lambda y: case when y <> 0 then exp(y - list_max(ps)) else 0 end)) = 0 then 1
              else list_sum(list_transform(ps, lambda y: case when y <> 0 then exp(y - list_max(ps)) else 0 end)) end)),
   list_transform(qs2, lambda x: x - (list_max(qs2) + ln(list_sum(list_transform(qs2, lambda y: exp(y - list_max(qs2)))))))),
 lambda z: case when z[1] > 0 then z[1] * (ln(z[1]) - z[2]) else 0 end))
"""


@query("x22_pair_divergence", sql=f"""
with {HEAD_PAIRS},
sums as (select *, list_transform(A, lambda a: list_sum(a)) as ps,
                list_transform(list_transform(B, lambda b: list_sum(b)), lambda x: case when x <> 0 then x else x + ln(1e-45) end) as qs2 from pr),
kl as (select q_class = s_class as same, {KL} as kl from sums)
select round(avg(kl) filter (where same), 6) as same_mean, round(avg(kl) filter (where not same), 6) as other_mean,
       round(avg(kl) filter (where same) - avg(kl) filter (where not same), 6) as separation from kl
""")
def x22_pair_divergence(spark, d):
    p = head_pairs(spark, d)
    k = p.select((F.col("same") == 1).alias("same"), M.kl_divergence(M.row_sums("A"), M.row_sums("B")).alias("kl"))
    g = k.agg(F.avg(F.when(F.col("same"), F.col("kl"))).alias("s"), F.avg(F.when(~F.col("same"), F.col("kl"))).alias("o"))
    return g.select(F.round("s", 6).alias("same_mean"), F.round("o", 6).alias("other_mean"),
                    F.round(F.col("s") - F.col("o"), 6).alias("separation"))


@query("a11_match_mean", sql=f"""
with {HEAD_PAIRS},
ps as (select {KEYS},
        list_avg(list_transform(A, lambda a: list_max(list_transform(B, lambda b: {DCOS('a', 'b')})))) as m from pr),
cs as (select episode, q_class, q_slot, s_class, round(avg(m), 9) as score from ps group by all)
select episode, q_class, q_slot, arg_min(s_class, struct_pack(ns := -score, c := s_class)) as pred,
       round(max(score), 6) as score from cs group by all
""")
def a11_match_mean(spark, d):
    return match_predictions(spark, d)


def match_predictions(spark, d):
    """Each query's class by the mean match score over the class's support rows."""
    ps = MK.match_scores(head_pairs(spark, d), KEYS.split(", "), {"m": ("maxsim_s", None)})
    cs = ps.groupBy("episode", "q_class", "q_slot", "s_class").agg(F.round(F.avg("m"), 9).alias("score"))
    return cs.groupBy("episode", "q_class", "q_slot").agg(
        F.min_by("s_class", F.struct(-F.col("score"), F.col("s_class"))).alias("pred"),
        F.round(F.max("score"), 6).alias("score"))


MATCH_PRED = f"""
with {HEAD_PAIRS},
ps as (select {KEYS},
        list_avg(list_transform(A, lambda a: list_max(list_transform(B, lambda b: {DCOS('a', 'b')})))) as m from pr),
cs as (select episode, q_class, q_slot, s_class, round(avg(m), 9) as score from ps group by all),
best as (select episode, q_class, q_slot, arg_min(s_class, struct_pack(ns := -score, c := s_class)) as pred from cs group by all),
acc as (select episode, avg(CAST(pred = q_class AS DOUBLE)) as acc, count(*) as n from best group by episode)
"""


@query("e3_match_accuracy", sql=MATCH_PRED + "select CAST(episode AS INTEGER) as episode, round(acc, 6) as acc, n from acc")
def e3_match_accuracy(spark, d):
    """Episodic accuracy of the match scores."""
    a = E.episode_accuracy(match_predictions(spark, d))
    return a.select(F.col("episode").cast("int").alias("episode"), F.round("acc", 6).alias("acc"), "n")


@query("e3_match_summary", sql=MATCH_PRED + """
select CAST(episode % 3 AS INTEGER) as run, round(avg(acc), 6) as mean, round(stddev_pop(acc), 6) as std, count(*) as count from acc group by all
union all select null, round(avg(acc), 6), round(stddev_pop(acc), 6), count(*) from acc
""")
def e3_match_summary(spark, d):
    """Mean and deviation of the match scores' accuracy per run (an episode's number modulo 3), and over all runs from the runs' states."""
    a = E.episode_accuracy(match_predictions(spark, d)).withColumn("run", (F.col("episode") % 3).cast("int"))
    runs = materialize(E.moments(a, "acc", ["run"]), "moments")
    every = E.finish_moments(E.merge_moments(runs)).withColumn("run", F.lit(None).cast("int"))
    return E.finish_moments(runs, ["run"]).unionByName(every)
