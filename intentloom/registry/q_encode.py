"""Proofs for tokens, vocabularies, id encodings, hashed vectors and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.constants import VOCAB_CAP
from intentloom.functions import text as T
from intentloom.functions import vectors as V
from intentloom.operators import encode as EN
from intentloom.operators import pairs as P
from intentloom.operators import score as SC
from intentloom.operators import subwords as SW
from intentloom.plans import split_build
from intentloom.registry import query
from intentloom.registry.sqlparts import (ANYVEC, BOW_TOKENS, CONV, HASHED_IDS, HINT, IDSTR, PART_UTT, SPLIT,
                                          TOK_VEC, TOKENS, TOKROWS, UTT, VSUM)
from intentloom.session import materialize
from intentloom.sources import views


def idstr(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("x2_token_count", sql=f"select uid, CAST(len({TOKENS('utterance')}) AS INTEGER) as n_tokens from ({UTT})")
def x2_token_count(spark, d):
    return views.utt(spark, d).select("uid", T.token_count("utterance").alias("n_tokens"))


@query("x3_pad_mask", sql=f"""
select uid, {IDSTR('ids')} as ids, {IDSTR("list_transform(ids, lambda x: CAST(x > 0 AS INTEGER))")} as mask from (
  select uid, list_resize({HASHED_IDS(TOKENS('utterance'))}, 48, 0) as ids from ({UTT}))
""")
def x3_pad_mask(spark, d):
    ids = EN.hashed_token_ids(views.utt(spark, d))
    p = ids.select("uid", T.pad_cut("ids", 48).alias("ids"))
    return p.select("uid", idstr(F.col("ids")).alias("ids"), idstr(T.attention_mask("ids")).alias("mask"))


VOCAB = f"""
select word, n, CAST(row_number() over (order by n desc, word) + 1 AS INTEGER) as word_id from
  (select token as word, count(*) as n from ({TOKROWS(UTT)}) where token <> '' group by token)
"""


@query("w4_vocab_ids", sql=f"select word, n, word_id from ({VOCAB})")
def w4_vocab_ids(spark, d):
    return EN.vocab_ids(EN.tokens(views.utt(spark, d)))


@query("l4_vocab_cap", sql=f"select word, word_id from ({VOCAB}) order by word_id limit 2000")
def l4_vocab_cap(spark, d):
    v = EN.vocab_ids(EN.tokens(views.utt(spark, d)), nmax=2000)
    return v.select("word", "word_id")


@query("j3_token_lookup", sql=f"""
with v as (select word, word_id from ({VOCAB}) order by word_id limit {VOCAB_CAP}),
t as ({TOKROWS(UTT)})
select t.uid, {IDSTR("list(coalesce(v.word_id, 1) order by t.pos)")} as ids
from t left join v on v.word = t.token group by t.uid
""")
def j3_token_lookup(spark, d):
    u = views.utt(spark, d)
    toks = EN.tokens(u)
    v = EN.vocab_ids(toks, nmax=VOCAB_CAP)
    return EN.token_ids(toks, v).select("uid", idstr(F.col("ids")).alias("ids"))


@query("a6_max_len", sql=f"""
select CAST(max(n) AS BIGINT) as max_len from (
  select len({TOKENS('utterance')}) as n from ({UTT})
  union all select len({TOKENS('utterance')}) from ({CONV})
  union all select len({TOKENS('text')}) from benchmark)
""")
def a6_max_len(spark, d):
    return EN.max_len(views.utt(spark, d), views.conv(spark, d), views.bench(spark, d))


@query("x12_pair_encode", sql=f"""
with sp as ({SPLIT(UTT)}),
s as (select uid, utterance, label from sp where part = 'train_seen'),
c as (select distinct label as label_name from s),
p as (select s.uid, s.utterance, c.label_name from s, c),
e as (select uid, label_name,
             {HASHED_IDS(TOKENS('utterance'))} as sid, {HASHED_IDS(TOKENS('label_name'))} as lid from p),
cut as (select *, case when len(sid) + len(lid) > 61 then list_slice(sid, 1, greatest(61 - len(lid), 0)) else sid end as s2 from e),
f as (select uid, label_name, list_concat([101], s2, [102], lid, [102]) as full_,
             list_concat(list_resize([]::INTEGER[], len(s2) + 2, 0), list_resize([]::INTEGER[], len(lid) + 1, 1)) as ty from cut)
select uid, label_name, {IDSTR('list_resize(full_, 64, 0)')} as input_ids,
       {IDSTR('list_resize(ty, 64, 1)')} as token_type_ids,
       {IDSTR("list_transform(list_resize(full_, 64, 0), lambda x: CAST(x > 0 AS INTEGER))")} as mask,
       CAST(least(len(full_), 64) AS INTEGER) as len from f
""")
def x12_pair_encode(spark, d):
    sp, _ = split_build.build(views.utt(spark, d), materialized=True)
    s = sp.where(F.col("part") == "train_seen").select("uid", "utterance", "label").withColumn("origin", F.lit("t"))
    # an encoded pair holds at most 61 ids of the text: no pair carries more; labels are hashed once each
    s = s.withColumn("sid", F.slice(T.hashed_ids(T.blank_tokens("utterance")), 1, 61))
    j = P.entailment_pairs(s, scope="origin", carry=("sid",), label_cols={"lid": T.hashed_ids(T.blank_tokens("label_name"))})
    e = j.select("uid", "label_name", T.pair_encode("sid", "lid", 64).alias("e"))
    return e.select("uid", "label_name", idstr(F.col("e.input_ids")).alias("input_ids"),
                    idstr(F.col("e.token_type_ids")).alias("token_type_ids"),
                    idstr(F.col("e.mask")).alias("mask"), F.col("e.len").cast("int").alias("len"))


@query("x13_tail_encode", sql=f"""
select uid, {IDSTR("list_resize(list_concat([101], case when len(ids) > 46 then list_slice(ids, len(ids) - 45, len(ids)) else ids end, [102]), 48, 0)")} as ids
from (select uid, {HASHED_IDS(TOKENS('utterance'))} as ids from ({UTT}))
""")
def x13_tail_encode(spark, d):
    ids = EN.hashed_token_ids(views.utt(spark, d))
    return ids.select("uid", idstr(T.tail_encode("ids", 48)).alias("ids"))


@query("p1a_hash_encode", sql=f"""
select uid, CAST({HINT('t')} % 64 AS BIGINT) as dim, count(*) as value from
  (select uid, unnest({BOW_TOKENS('utterance')}) as t from ({UTT})) group by all
""")
def p1a_hash_encode(spark, d):
    return EN.hash_encode(views.utt(spark, d), 64, long_form=True)


@query("j10_word_vec_join", sql=f"""
with t as ({TOKROWS("select p_partkey as uid, p_name as utterance from part")}), v as ({TOK_VEC})
select t.uid, CAST(t.pos AS INTEGER) as pos, t.token, round({VSUM('v.vec')}, 6) as vec_sum
from t left join v on v.word = t.token
""")
def j10_word_vec_join(spark, d):
    p = views.part_utt(spark, d)
    j = EN.word_vectors(EN.tokens(p), views.tok_vec(spark, d))
    return j.select("uid", F.col("pos").cast("int").alias("pos"), "token", F.round(V.vsum("vec"), 6).alias("vec_sum"))


POOL_SRC = f"""
t as ({TOKROWS("select p_partkey as uid, p_name as utterance from part")}), v as ({TOK_VEC}),
c as (select uid, token, count(*) as n from t where token <> '' group by uid, token),
x as (select c.uid, c.n, unnest(range(len(v.vec))) as dim, CAST(unnest(v.vec) AS DOUBLE) as val from c join v on v.word = c.token)
"""


@query("a12_pool_max_mean", sql=f"""
with {POOL_SRC},
g as (select uid, dim, max(val) as mx, sum(n * val) / sum(n) as mn from x group by uid, dim)
select uid, round(sum(mx), 6) as max_pool_sum, round(sqrt(sum(mx * mx)), 6) as max_pool_norm,
       round(sum(mn), 6) as mean_pool_sum, round(sqrt(sum(mn * mn)), 6) as mean_pool_norm from g group by uid
""")
def a12_pool_max_mean(spark, d):
    p = views.part_utt(spark, d)
    pooled = EN.pool_max_mean(EN.tokens(p), views.tok_vec(spark, d), texts=p)
    return pooled.select("uid", *EN.summarize_vec("max_pool"), *EN.summarize_vec("mean_pool"))


@query("x15_weighted_pool", sql=f"""
with t as ({TOKROWS("select p_partkey as uid, p_name as utterance from part")}), v as ({TOK_VEC}),
idf as (select token as word, ln(CAST((select count(distinct uid) from t) AS DOUBLE) / count(distinct uid)) as w
        from t where token <> '' group by token),
j as (select t.uid, t.pos, v.vec, idf.w from t join v on v.word = t.token join idf on idf.word = t.token where t.token <> ''),
a as (select *, exp(w - max(w) over (partition by uid)) as e from j),
b as (select *, e / sum(e) over (partition by uid) as att from a),
x as (select uid, unnest(range(len(vec))) as dim, att * CAST(unnest(vec) AS DOUBLE) as val from b),
g as (select uid, dim, sum(val) as s from x group by uid, dim)
select uid, round(sum(s), 6) as pooled_sum, round(sqrt(sum(s * s)), 6) as pooled_norm from g group by uid
""")
def x15_weighted_pool(spark, d):
    u = views.part_utt(spark, d)
    toks = EN.tokens(u)
    out = EN.weighted_pool(toks, views.tok_vec(spark, d), EN.idf_weights(toks, texts=u))
    return out.select("uid", *EN.summarize_vec("pooled"))


@query("x17_piecewise_pool", sql=f"""
with t as ({TOKROWS("select p_partkey as uid, p_name as utterance from part")}), v as ({TOK_VEC}),
n as (select uid, count(*) as len from t group by uid),
j as (select t.uid, CAST(floor(CAST(t.pos * 3 AS DOUBLE) / n.len) AS INTEGER) as segment, v.vec
      from t join n using (uid) join v on v.word = t.token),
x as (select uid, segment, unnest(range(len(vec))) as dim, CAST(unnest(vec) AS DOUBLE) as val from j),
g as (select uid, segment, dim, max(val) as m from x group by all)
select uid, round(sum(m), 6) as pooled_sum, round(sqrt(sum(m * m)), 6) as pooled_norm from g group by uid
""")
def x17_piecewise_pool(spark, d):
    toks = EN.tokens(views.part_utt(spark, d))
    out = EN.piecewise_pool(toks, views.tok_vec(spark, d))
    return out.select("uid", *EN.summarize_vec("pooled"))


@query("l3_length_order", sql=f"""
with l as (select uid, CAST(len({TOKENS('utterance')}) AS BIGINT) as len from ({UTT}))
select uid, len, CAST(row_number() over (order by len desc, uid) AS BIGINT) as sorted_pos, CAST(row_number() over (order by uid) AS BIGINT) as pos from l
""")
def l3_length_order(spark, d):
    return EN.restore_order(EN.length_order(views.utt(spark, d)).select("uid", "len", "sorted_pos")).select("uid", "len", "sorted_pos", "pos")


@query("l3_length_buckets", sql=f"""
select uid, CAST(n AS BIGINT) as len, CAST(ceil(log2(CAST(greatest(n, 1) AS DOUBLE))) AS INTEGER) as bucket
from (select uid, len({TOKENS('utterance')}) as n from ({UTT}))
""")
def l3_length_buckets(spark, d):
    return EN.length_buckets(views.utt(spark, d)).select("uid", "len", "bucket")


ZS = f"""
t as (select uid, label, unnest({BOW_TOKENS('utterance')}) as word from ({PART_UTT})),
lw as (select distinct label, lower(label) as word from ({PART_UTT})),
v as ({ANYVEC("select word from t union select word from lw")}),
qx as (select t.uid, t.label, unnest(range(len(v.vec))) as dim, CAST(unnest(v.vec) AS DOUBLE) as val from t join v using (word)),
q as (select uid, label, list(m order by dim) as qv from (select uid, label, dim, avg(val) as m from qx group by all) group by uid, label),
l as (select lw.label as cand, list_transform(v.vec, lambda x: CAST(x AS DOUBLE)) as lv from lw join v using (word)),
s as (select q.uid, q.label, l.cand,
             round(coalesce(list_dot_product(q.qv, l.lv) / nullif(sqrt(list_dot_product(q.qv, q.qv)) * sqrt(list_dot_product(l.lv, l.lv)), 0), -2.0), 9) as s
      from q, l)
"""


@query("j7_zero_shot_cosine", sql=f"""
with {ZS}
select uid, label, arg_min(cand, struct_pack(ns := -s, c := cand)) as pred, round(max(s), 6) as score from s group by uid, label
""")
def j7_zero_shot_cosine(spark, d):
    from intentloom.plans import zero_shot
    return zero_shot.predictions(spark, views.part_utt(spark, d), views.table(spark, d, "embeddings"))


@query("j7_indexed", sql=f"""
with {ZS}
select uid, label, arg_min(cand, struct_pack(ns := -s, c := cand)) as pred, round(max(s), 6) as score from s group by uid, label
""")
def j7_indexed(spark, d):
    """Through the metric index on unit vectors: the same rows."""
    from intentloom.plans import zero_shot
    return zero_shot.predictions(spark, views.part_utt(spark, d), views.table(spark, d, "embeddings"), index=True)


@query("p2_pair_scoring", sql=f"""
with {ZS}
select uid, label, cand as label_name, round(s, 6) as score,
       CAST(row_number() over (partition by uid order by s desc, cand) AS BIGINT) as rank from s
""")
def p2_pair_scoring(spark, d):
    from intentloom.plans import zero_shot
    s = zero_shot.pair_table(spark, views.part_utt(spark, d), views.table(spark, d, "embeddings"))
    r = SC.label_ranking(s.withColumnRenamed("label_name", "label").withColumnRenamed("truth", "t"),
                         higher_is_better=True)
    return r.select("uid", F.col("t").alias("label"), F.col("label").alias("label_name"),
                    F.round("score", 6).alias("score"), "rank")


def PIECES(tokens: str) -> str:
    """A stand-in vocabulary from tokens: their first 1 to 3 characters, and all pieces of 1 or 2 characters further on."""
    return f"""
raw as ({tokens}), words as (select distinct token from raw where token <> ''),
piece as (select distinct piece from (
            select substr(token, 1, unnest([1, 2, 3])) as piece from words
            union all select '##' || substr(token, unnest(range(2, 1 + len(token)))::int, 1) from words
            union all select '##' || substr(token, unnest(range(2, len(token)))::int, 2) from words where len(token) <= 12)),
pieces as (select piece, CAST(1000 + row_number() over (order by piece) AS INTEGER) as id from piece),
cuts as (select token, s, l, case when s > 0 then '##' else '' end || substr(token, (s + 1)::int, l) as piece
         from (select token, unnest(range(len(token))) as s from words where len(token) <= 100), (select unnest([1, 2, 3]) as l) where s + l <= len(token)),
best as (select token, s, max(l) as l, arg_max(id, l) as id from cuts join pieces using (piece) group by token, s),
walk(token, at_, ids) as (select token, 0::bigint, []::INTEGER[] from words
         union all select w.token, w.at_ + b.l, list_append(w.ids, b.id) from walk w join best b on b.token = w.token and b.s = w.at_),
done as (select words.token, coalesce(any_value(ids) filter (at_ = len(words.token)), [100]) as ids from words left join walk using (token) group by words.token)"""


def stand_in_pieces(toks):
    """``PIECES`` as a table ``(piece, piece_id)``."""
    from intentloom.operators.rank import global_rank
    w = toks.where(F.col("token") != "").select("token").distinct()
    n = F.char_length("token")
    none = F.array().cast("array<string>")
    first = F.array(*(F.substring("token", 1, i) for i in (1, 2, 3)))
    one = F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.concat(F.lit("##"), F.substring("token", i, F.lit(1))))).otherwise(none)
    two = F.when((n > 2) & (n <= 12), F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.concat(F.lit("##"), F.substring("token", i, F.lit(2))))).otherwise(none)
    # written: the order below reads it twice
    p = materialize(w.select(F.explode(F.array_distinct(F.concat(first, one, two))).alias("piece")).distinct(), "pieces")
    return global_rank(p, [F.col("piece")], "r").select("piece", (F.col("r") + 1000).cast("int").alias("piece_id"))


@query("x13_subword_tail", sql=f"""
with recursive {PIECES(TOKROWS(UTT))},
t as (select uid, flatten(list(coalesce(ids, []::INTEGER[]) order by pos)) as ids from raw left join done using (token) group by uid)
select uid, {IDSTR("list_resize(list_concat([101], case when len(ids) > 46 then list_slice(ids, len(ids) - 45, len(ids)) else ids end, [102]), 48, 0)")} as ids from t
""")
def x13_subword_tail(spark, d):
    """Single texts as subword ids: the token budget counts pieces."""
    toks = materialize(EN.tokens(views.utt(spark, d)), "tokens")
    ids = SW.subword_ids(toks, stand_in_pieces(toks))
    return ids.select("uid", idstr(T.tail_encode("ids", 48)).alias("ids"))


@query("x12_subword_pairs", sql=f"""
with recursive {PIECES(TOKROWS("select p_partkey as uid, p_name as utterance from part") + " union all " + TOKROWS("select distinct -1 as uid, p_type as utterance from part"))},
lab as (select x.uid as label_name, flatten(list(ids order by pos)) as lid from ({TOKROWS("select distinct p_type from part", "p_type", "p_type")}) x join done using (token) group by x.uid),
s as (select uid, flatten(list(ids order by pos)) as sid from raw join done using (token) where uid >= 0 group by uid),
e as (select uid, label_name, lid, case when len(sid) + len(lid) > 61 then list_slice(sid, 1, greatest(61 - len(lid), 0)) else sid end as s2 from s, lab),
f as (select uid, label_name, list_concat([101], s2, [102], lid, [102]) as full_ from e)
select uid, label_name, {IDSTR('list_resize(full_, 64, 0)')} as input_ids, CAST(least(len(full_), 64) AS INTEGER) as len from f
""")
def x12_subword_pairs(spark, d):
    """Entailment pairs as subword ids: texts and label names cut once, pairs within 64 pieces."""
    u = views.part_utt(spark, d).select("uid", "utterance", "label")
    names = u.select("label").distinct()
    toks = materialize(EN.tokens(u), "tokens")
    ltoks = materialize(EN.tokens(names, text="label", key="label"), "label-tokens")
    pieces = materialize(stand_in_pieces(toks.select("token").unionByName(ltoks.select("token"))), "pieces")
    sid = SW.subword_ids(toks, pieces).withColumnRenamed("ids", "sid")
    lid = SW.subword_ids(ltoks, pieces, key="label").withColumnRenamed("ids", "lid")
    pairs = SC.pair_scores(SC.with_scope(sid, "all"), SC.with_scope(lid, "all"), lambda c: T.pair_encode("sid", c["lid"], 64))
    return pairs.select("uid", F.col("label").alias("label_name"), idstr(F.col("score.input_ids")).alias("input_ids"), F.col("score.len").cast("int").alias("len"))
