"""Shared DuckDB SQL fragments for the oracle side (views over the test tables)."""

SEED = 30


def H(salt: str, *keys: str, seed: int = SEED) -> str:
    """DuckDB form of ``functions.order.seeded_key``."""
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws('|', '{seed}', '{salt}', {ks}))"


def HINT(expr: str, width: int = 8) -> str:
    """DuckDB form of ``functions.order.hash_int``: md5 hex prefix as BIGINT."""
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, {width})) AS BIGINT)"


def HEXINT(hexexpr: str, width: int = 8) -> str:
    return f"CAST(('0x' || substr({hexexpr}, 1, {width})) AS BIGINT)"


UTT = "select doc_id as uid, text as utterance, source as label, doc_id as ord from documents"
UTT_LANG = "select doc_id as uid, text as utterance, lang as label, doc_id as ord from documents"
PART_UTT = "select p_partkey as uid, p_name as utterance, p_type as label, p_partkey as ord from part"
CONV = ("select CAST(conv_id AS BIGINT) * 4294967296 + turn as uid, text as utterance, role as label, "
        "CAST(conv_id AS BIGINT) * 4294967296 + turn as ord from conversations")
VEC = "select vec_id as uid, CAST(label AS VARCHAR) as label, embedding as vec from embeddings"

# strip like Python str.strip(), split on single blanks
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def TOKENS(x: str) -> str:
    return f"string_split({STRIP.format(x=x)}, ' ')"


def SUPPORT(src: str, k: int, salt: str = "shot") -> str:
    """K rows per label in seeded order."""
    return (f"select * exclude (rn) from (select *, row_number() over (partition by label "
            f"order by {H(salt, 'uid')}, uid) as rn from ({src})) where rn <= {k}")


def PROTOS(support: str) -> str:
    """Element-wise mean per label as a DOUBLE list."""
    return (f"select label, list(x order by dim) as proto, any_value(n) as n_support from ("
            f"select label, dim, avg(x) as x, count(*) as n from ("
            f"select label, unnest(range(len(vec))) as dim, CAST(unnest(vec) AS DOUBLE) as x from ({support})"
            f") group by label, dim) group by label")


def REPORT(pred: str) -> str:
    """Classification report (E1) over a relation with columns label, pred."""
    return f"""
with pc as (select label, pred, count(*) as n from ({pred}) group by label, pred),
tp as (select label, n as tp from pc where label = pred),
sup as (select label, sum(n) as support from pc where label is not null group by label),
pp as (select pred as label, sum(n) as npred from pc where pred is not null group by pred),
cl as (select coalesce(s.label, p.label) as label, coalesce(t.tp, 0) as tp,
              coalesce(s.support, 0) as support, coalesce(p.npred, 0) as npred
       from sup s full join pp p on s.label = p.label left join tp t on t.label = coalesce(s.label, p.label)),
m as (select label, support, tp,
             coalesce(CAST(tp AS DOUBLE) / nullif(npred, 0), 0.0) as precision,
             coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) as recall from cl),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1 from m),
s as (select sum(support) as total, sum(tp) as tps, avg(precision) as mp, avg(recall) as mr, avg(f1) as mf,
             sum(precision * support) as wp, sum(recall * support) as wr, sum(f1 * support) as wf from f)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
       CAST(support AS BIGINT) as support from f
union all select 'accuracy', NULL, NULL, round(coalesce(CAST(tps AS DOUBLE) / nullif(total, 0), 0.0), 6),
       CAST(total AS BIGINT) from s
union all select 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(total AS BIGINT) from s
union all select 'weighted avg', round(coalesce(wp / nullif(total, 0), 0.0), 6),
       round(coalesce(wr / nullif(total, 0), 0.0), 6), round(coalesce(wf / nullif(total, 0), 0.0), 6),
       CAST(total AS BIGINT) from s
"""


NEAREST = """
select q.uid, q.label, arg_min(p.label, struct_pack(d := round(list_distance(CAST(q.vec AS DOUBLE[]), p.proto), 9), c := p.label)) as pred,
       round(min(round(list_distance(CAST(q.vec AS DOUBLE[]), p.proto), 9)), 6) as score
from ({queries}) q, ({protos}) p group by q.uid, q.label
"""


def DEDUP(src: str) -> str:
    """A2: last label wins, first position kept."""
    return (f"select arg_min(uid, ord) as uid, utterance, arg_max(label, ord) as label, min(ord) as ord "
            f"from ({src}) group by utterance")


def ROLES(src: str, pct: int = 33, m: int | None = None) -> str:
    """Labels in seeded order, the first m (or (n * pct) div 100) are novel."""
    lim = str(m) if m is not None else f"floor(CAST(cnt * {pct} AS DOUBLE) / 100.0)"
    return (f"select label, case when r <= {lim} then 'novel' else 'seen' end as role, "
            f"case when r <= {lim} then CAST(r AS BIGINT) end as novel_rank from ("
            f"select label, row_number() over (order by {H('novel', 'label')}, label) as r, count(*) over () as cnt "
            f"from (select distinct label from ({src}) where label is not null))")


def RANKED(src: str, salt: str = "split") -> str:
    return (f"select *, CAST(row_number() over (partition by label order by {H(salt, 'uid')}, uid) AS BIGINT) as rn, "
            f"count(*) over (partition by label) as n from ({src})")


def SPLIT(src: str, pct: int = 33, shots=(1, 5), num: int = 2, den: int = 3, m: int | None = None,
          roles_src: str | None = None, dedup: str | None = None) -> str:
    """The whole split table: uid, utterance, label, ord, role, part, k."""
    ks = ", ".join(str(k) for k in (0, *shots))
    return f"""
select uid, utterance, label, ord, role, part, CAST(k AS INTEGER) as k from (
  select *, case when k = 0 then
      (case when role = 'seen' then (case when rn <= tt then 'train_seen' else 'test_seen' end)
            else (case when rn > tt then 'test_novel' end) end)
    else (case when rn <= least(k, tt) then 'support_' || role end) end as part
  from (select *, floor(CAST(n * {num} AS DOUBLE) / {float(den)}) as tt, unnest([{ks}]) as k
        from ({RANKED(f"select d.*, r.role from ({dedup or DEDUP(src)}) d join ({ROLES(roles_src or src, pct, m)}) r using (label)")})))
where part is not null"""


def QUERY_ROWS(k: int = 5) -> str:
    return f"select * from ({VEC}) where uid not in (select uid from ({SUPPORT(VEC, k)}))"


def NEAREST_VEC(k: int = 5) -> str:
    return NEAREST.format(queries=QUERY_ROWS(k), protos=PROTOS(SUPPORT(VEC, k)))


def DIST_SCORES(k: int = 5) -> str:
    """(uid, truth, label, score = -distance)."""
    return (f"select q.uid, q.label as truth, p.label, -round(list_distance(CAST(q.vec AS DOUBLE[]), p.proto), 9) as score "
            f"from ({QUERY_ROWS(k)}) q, ({PROTOS(SUPPORT(VEC, k))}) p")


def HASHED_IDS(tok_list: str, vocab: int = 30000) -> str:
    return f"list_transform({tok_list}, lambda t: CAST(1000 + {HINT('t')} % {vocab} AS INTEGER))"


def IDSTR(lst: str) -> str:
    return f"array_to_string({lst}, ',')"


def TOKROWS(src: str, text: str = "utterance", key: str = "uid") -> str:
    """posexplode of blank tokens: (uid, pos, token), pos 0-based."""
    return (f"select {key} as uid, unnest(range(len(t))) as pos, unnest(t) as token from "
            f"(select {key}, {TOKENS(text)} as t from ({src}))")


BOW = "list_filter(string_split({strip}, ' '), lambda t: t <> '')"


def BOW_TOKENS(x: str) -> str:
    return BOW.format(strip=STRIP.format(x=f"lower({x})"))


TOK_VEC = f"""
select w.word, e.embedding as vec from
  (select distinct token as word from ({TOKROWS("select p_partkey as uid, p_name as utterance from part")}) where token <> '') w
  join embeddings e on e.vec_id = {HINT('w.word')} % (select count(*) from embeddings)
"""


def ANYVEC(words: str) -> str:
    """hashed word vectors for the distinct words of a relation with column word."""
    return (f"select w.word, e.embedding as vec from (select distinct word from ({words})) w "
            f"join embeddings e on e.vec_id = {HINT('w.word')} % (select count(*) from embeddings)")


def VSUM(x: str) -> str:
    return f"list_reduce(list_transform({x}, lambda v: CAST(v AS DOUBLE)), lambda a, b: a + b)"


def VNORM(x: str) -> str:
    return f"sqrt(list_reduce(list_transform({x}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda a, b: a + b))"


def DRAW(src: str, classes: str, m: int, salt: str, cols: str, first: int = 0) -> str:
    """m rows per (episode, class): drawn without replacement by random picks, in random order; classes of fewer
    rows repeat all of them (W13/W14)."""
    order = H(f"{salt}-order", "episode", "label", "c", "rn")
    return f"""
select sl.episode, sl.class_id, sl.label, CAST(sl.slot AS INTEGER) as slot, {', '.join('rk.' + c.strip() for c in cols.split(','))}
from (
  with recursive d as (select c.*, z.n, {m} // z.n as whole, {m} % z.n as rest
                       from ({classes}) c join (select label, count(*) as n from ({src}) group by label) z using (label)),
  f(episode, label, class_id, n, rest, i, picks) as (
    select episode, label, class_id, n, rest, 0, []::BIGINT[] from d
    union all
    select episode, label, class_id, n, rest, i + 1, list_append(picks, case when list_contains(picks, t) then n - rest + i + 1 else t end)
    from (select *, 1 + {HEXINT(H(salt, 'episode', 'label', '(i + 1)'), 15)} % (n - rest + i + 1) as t from f where i < rest)),
  e as (select episode, label, class_id, 0 as c, unnest(picks) as rn from f where i = rest
        union all select episode, label, class_id, a.c, b.rn from d, range(1, whole + 1) a(c), range(1, n + 1) b(rn) where whole > 0)
  select *, row_number() over (partition by episode, label order by {order}, rn) - 1 + {first} as slot from e) sl
join (select *, row_number() over (partition by label order by {H('ep-perm', 'uid')}, uid) as rn from ({src})) rk
  on rk.label = sl.label and rk.rn = sl.rn
"""


def EPISODES(src: str, E: int, N: int, K: int, Q: int, cols: str = "uid, vec", queries: str | None = None, apart: bool = True) -> str:
    """Episode samples (W12/W13/W14): episode, class_id, label, slot, role + cols."""
    classes = f"""
select CAST(episode AS INTEGER) as episode, label, CAST(rn - 1 AS INTEGER) as class_id from (
  select e.episode, l.label, row_number() over (partition by e.episode order by {H('ep-class', 'e.episode', 'l.label')}, l.label) as rn
  from (select distinct label from ({queries or src})) l, (select unnest(range({E})) as episode) e) where rn <= {N}
"""
    if queries is None and apart:
        drawn = DRAW(src, classes, K + Q, "ep-draw", cols)
    else:
        drawn = (f"select * from ({DRAW(src, classes, K, 'ep-support', cols)}) union all "
                 f"select * from ({DRAW(queries or src, classes, Q, 'ep-query', cols, K)})")
    return f"select *, case when slot < {K} then 'support' else 'query' end as role from ({drawn})"


VEC_HEADS = ("select vec_id as uid, CAST(label AS VARCHAR) as label, "
             "list_transform(range(4), lambda h: list_slice(CAST(embedding AS DOUBLE[]), h * 16 + 1, h * 16 + 16)) as heads "
             "from embeddings")


def DCOS(a: str, b: str) -> str:
    """cosine with the divisor floored at 1e-8 (DuckDB)."""
    return (f"(list_dot_product({a}, {b}) / (case when sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) > 1e-8 "
            f"then sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) else 1e-8 end))")


def DFLOOR(x: str) -> str:
    return f"(case when ({x}) > 1e-8 then ({x}) else 1e-8 end)"
