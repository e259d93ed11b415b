"""Registered queries ``opN_<name>``: each operator over its whole table, reduced to the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from intentloom.llm.common import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return put


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    from intentloom.llm.suffix_dedup import suffix_dedup
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


@query("op2_warc", """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, octet_length(encode(payload)) as payload_bytes, sha1(payload) as h,
             min(page_id) over (partition by payload) as first_id from p),
b as (select *, unnest(range(32)) as k from d),
s as (select page_id, any_value(payload_bytes) as payload_bytes, any_value(first_id) as first_id,
             string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
               ((('0x' || substr(h || '0000', 1 + (k * 5) // 4, 3))::bigint) >> (12 - 5 - (k * 5) % 4)) & 31)::int, 1), '' order by k)
               as payload_digest
      from b group by page_id)
select page_id, payload_bytes, payload_digest,
       case when first_id < page_id then 'revisit' else 'response' end as record_type,
       case when first_id < page_id then first_id end as refers_to
from s
""")
def op2(spark, sf_dir):
    from intentloom.llm.warc import round_trip
    return round_trip(table(spark, sf_dir, "pages")).drop("file", "offset")


@query("op3_ann")
def op3(spark, sf_dir):
    from intentloom.llm.ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op4_hilbert_shards")
def op4(spark, sf_dir):
    from intentloom.llm.sharding import hilbert_shards
    return hilbert_shards(table(spark, sf_dir, "documents"), 40)


@query("op7_bottom_k")
def op7(spark, sf_dir):
    from intentloom.llm.fingerprints import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op9_sainte_lague_mix", r"""
with r as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, text from documents),
h as (select *, md5('11|' || coalesce(doc_id::varchar, '') || '|' || size) as h from r),
src as (select source, sum(size)::bigint as source_size from r group by source),
w as (select *, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, sum(source_size) over () as total from src),
f as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as fill from w),
lv as (select *, (1.5::double * total - coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as level from f),
t as (select *, least(cap, max(level) over () * weight) as target, greatest(1, ceil(source_size / (10 * sqrt(total) + 1)))::bigint as shards from lv),
t2 as (select *, round(sum(target) over () / 16)::bigint as seats from t),
q1 as (select source, seats, target / (2 * j + 1) as q, j from t2, range(0, 1 + seats) x(j)
       where j <= 1 + ceil(target * (seats + (select count(*) from t2)) / (1 + (select sum(target) from t2)))),
won as (select source, count(*) as quota from (
          select source, q, seats, row_number() over (order by q desc, source nulls last, j) as n from q1 where q > 0) where n <= seats group by source),
sq as (select t2.*, coalesce(won.quota, 0) as quota from t2 left join won on t2.source is not distinct from won.source),
p as (select h.*, sq.source_size, sq.target, sq.quota, ('0x' || substr(h, 1, 12))::bigint % sq.shards as shard
      from h join sq on h.source is not distinct from sq.source),
sh as (select source, shard, sum(size)::bigint as shard_size, any_value(quota) as quota from p group by source, shard),
q2 as (select source, shard, quota, shard_size / (2 * j + 1) as q, j from (select *, count(*) over (partition by source) as n, sum(shard_size) over (partition by source) as z from sh) y,
       range(0, 1 + quota) x(j) where j <= 2 + ceil(shard_size * (quota + n) / (1 + z))),
won2 as (select source, shard, count(*) as quota from (
          select *, row_number() over (partition by source order by q desc, shard, j) as n from q2 where q > 0) where n <= quota group by source, shard),
k as (select sh.source, sh.shard, sh.shard_size, ceil(sh.shard_size / 16)::bigint as blocks,
             least(coalesce(won2.quota, 0), 2 * ceil(sh.shard_size / 16)::bigint) as quota,
             ('0x' || substr(md5('11|run|' || coalesce(sh.source, '') || '|' || sh.shard), 1, 12))::bigint as seed
      from sh left join won2 on sh.source is not distinct from won2.source and sh.shard = won2.shard),
d as (select p.doc_id, p.size, p.source_size, p.target, k.blocks, k.quota,
             case when k.blocks > 0 then k.quota // k.blocks else 0 end as passes, case when k.blocks > 0 then k.quota % k.blocks else 0 end as rest,
             case when k.blocks > 0 then k.seed % k.blocks else 0 end as begin_,
             sum(p.size) over (partition by p.source, p.shard order by p.h, p.doc_id nulls last, p.size rows between unbounded preceding and current row) as stop
      from p join k on p.source is not distinct from k.source and p.shard = k.shard)
select doc_id, size, source_size, target,
       (passes * size
        + greatest(0, least(stop, (begin_ + rest) * 16) - greatest(stop - size, begin_ * 16))
        + greatest(0, least(stop, greatest(begin_ + rest - blocks, 0) * 16) - (stop - size)))::bigint as taken
from d
""")
def op9(spark, sf_dir):
    from intentloom.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op5_path_templates")
def op5(spark, sf_dir):
    from intentloom.llm.url_filter import judge_urls, labelled_pages
    pages = labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judge_urls(pages, RULES).drop("bad_share")


@query("op6_language_id")
def op6(spark, sf_dir):
    from intentloom.llm.langid import held_out, identify, learn
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = learn(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


@query("op10_best_two_fit")
def op10(spark, sf_dir):
    import public_tokenizers

    from intentloom.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)


@query("op8_chosen_path_join", r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, unnest(list_distinct(case
        when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n na on na.doc_id = x join n nb on nb.doc_id = y where 5 * c >= 4 * (na.n + nb.n - c)),
r(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from r join l on l.x = r.y),
k as (select x, min(y) as class_id from r group by x),
d as (select x, count(*) as n_links from l group by x)
select k.x as doc_id, k.class_id, coalesce(d.n_links, 0) as n_links from k left join d on d.x = k.x
""")
def op8(spark, sf_dir):
    from intentloom.llm.jaccard_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op11_importance_resampling", r"""
with tab as (select list(c order by i) as t from (
       select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) as c from range(256) r(i))),
d as (select row_number() over () as r, 0 as side, doc_id, text from documents),
a as (select r, side, text from d union all select row_number() over (), 1, text from benchmark),
w as (select r, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from a),
v as (select w, xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (1 + 2 * i)::int, 2))::bigint),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 as bucket from (select distinct w from w), tab),
f as (select r, side, bucket, count(*) as c from w join v using (w) group by 1, 2, 3),
n as (select range as bucket, coalesce(s, 0)::double as s, coalesce(t, 0)::double as t, sum(coalesce(s, 0)) over ()::double as all_s, sum(coalesce(t, 0)) over ()::double as all_t
      from range(10000) left join (select bucket, sum(c) filter (side = 0) as s, sum(c) filter (side = 1) as t from f group by 1) on bucket = range),
g as (select bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as gain from n),
m as (select r, sum(c)::bigint as n_features, floor(sum(c * gain)::double / sum(c))::bigint as weight from f join g using (bucket) where side = 0 group by r),
h as (select r, doc_id, (('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double as u from d),
e as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
             (coalesce(weight, 0) + floor(-1000::double * ln(-ln(u))))::bigint as score from h left join m using (r)),
k as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as p,
             10 * count(*) over (partition by n_features >= 20) // 100 as take from e)
select doc_id, n_features, weight, score, case when n_features >= 20 and p <= take then p end as rank from k
""")
def op11(spark, sf_dir):
    from intentloom.llm.resampling import importance_resample
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resample(docs, target, 1, 1).select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_whitening")
def op13(spark, sf_dir):
    from intentloom.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


def _entropy_sql(number: int, name: str, chars: str, window: int, bits: float) -> str:
    """Spans of one entropy kind: every window's entropy from its own character counts, then merged."""
    return f"""
r{number} as (select r, unnest(regexp_extract_all(text, '[{chars}]{{{window},}}')) as x, unnest(range(1, 1 + len(regexp_extract_all(text, '[{chars}]{{{window},}}')))) as i,
       unnest(regexp_split_to_array(text, '[{chars}]{{{window},}}')[:-2]) as gap from d),
o{number} as (select r, x, sum(len(gap) + len(x)) over (partition by r order by i) - len(x) as place from r{number}),
w{number} as (select x, s, unnest(string_split(substr(x, (s + 1)::int, {window}), '')) as ch from (
       select x, unnest(range(len(x) - {window - 1})) as s from (select distinct x from r{number}
         where not regexp_full_match(x, '[0-9]+|[a-z]+|[A-Z]+|[A-Z][a-z]+|.*EXAMPLE.*|(?i:(0123456789)+(abcdef)*)|(?i:.*abcdefghijklmnop.*)')))),
h{number} as (select x, s from (select x, s, ch, count(*) as c from w{number} group by x, s, ch) group by x, s
       having log2({window}) - sum(c * log2(c)) / {window} >= {bits} - 1e-9),
m{number} as (select x, s, sum(new) over (partition by x order by s) as island from (
       select x, s, (s > coalesce(lag(s) over (partition by x order by s) + {window}, -1))::int as new from h{number})),
e{number} as (select r, {number} as k, '{name}' as kind, place + a as s, place + b as e
       from o{number} join (select x, min(s) as a, max(s) + {window} as b from m{number} group by x, island) using (x)),"""


def _secret_sql() -> str:
    from intentloom.llm.secrets import BASE, CLASSES
    base = [(n, p.replace("(?<![0-9a-f])", "").replace("'", "''"), g, least) for n, p, g, least in BASE]
    parts = ["with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),"]
    for k, (name, p, g, least) in enumerate(base):
        parts.append(f"""
b{k} as (select r, {k} as k, '{name}' as kind, e - len(x) as s, e, part from (select r, x, part, sum(len(gap) + len(x)) over (partition by r order by i) as e from (
       select r, unnest(regexp_extract_all(text, '{p}')) as x, unnest(regexp_extract_all(text, '{p}', {g})) as part,
              unnest(range(1, 1 + len(regexp_extract_all(text, '{p}')))) as i, unnest(regexp_split_to_array(text, '{p}')[:-2]) as gap from d))
       where len(part) >= {least}),""")
    parts += [_entropy_sql(k, *c) for k, c in enumerate(CLASSES, len(base))]
    every = " union all ".join([f"select r, k, kind, s, e from b{k}" for k in range(len(base))] + [f"select r, k, kind, s, e from e{k + len(base)}" for k in range(len(CLASSES))])
    counts = ", ".join(f"count(*) filter (k = {k}) as n_{n}" for k, (n, *_) in enumerate(base))
    parts.append(f"""
a as (select r, {counts}, string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) filter (k < {len(base)}) as base,
             string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) as spans, count(*) filter (k >= {len(base)}) as n_entropy from ({every}) group by r)
select doc_id, {", ".join(f"coalesce(n_{n}, 0) as n_{n}" for n, *_ in base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_entropy, 0) as n_entropy from d left join a using (r)""")
    return "".join(parts)


@query("op12_secret_scan", _secret_sql())
def op12(spark, sf_dir):
    from intentloom.llm.secrets import secret_digests
    return secret_digests(table(spark, sf_dir, "documents"))
