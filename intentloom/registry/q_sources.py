"""Proofs for sources and sinks: each writes a layout from the test tables to
a fresh folder under the shared checkpoint root, reads it back with the
reader, and returns what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.functions.order import hash_int
from intentloom.operators import labels as L
from intentloom.operators import split as S
from intentloom.operators import sweeps as W
from intentloom.plans import split_build
from intentloom.registry import query
from intentloom.registry.q_sweeps import LS_STEPS
from intentloom.registry.sqlparts import DEDUP, HINT, RANKED, SPLIT, TOK_VEC, UTT, VSUM
from intentloom.session import shared_dir
from intentloom.sources import exporters as X
from intentloom.sources import readers as R
from intentloom.sources import sinks as K
from intentloom.sources import views


@query("s1_tsv_roundtrip", sql="""
select CAST(row_number() over (order by p_partkey) - 1 AS BIGINT) as ord, p_type as label, p_name as utterance from part
""")
def s1_tsv_roundtrip(spark, d):
    path = shared_dir(spark, "s1")
    X.write_tsv(views.part_utt(spark, d), path, order="uid")
    return R.read_tsv(spark, path, ordered=True).select("ord", "label", "utterance")


@query("s2_line_scan", sql=f"""
select p_type as label, p_name as utterance, CAST(len(string_split(p_name, ' ')) AS INTEGER) as n_tokens from part
""")
def s2_line_scan(spark, d):
    path = shared_dir(spark, "s2")
    X.write_lines(views.part_utt(spark, d), path)
    r = R.read_lines(spark, path)
    return r.select("label", "utterance", F.size(F.split("utterance", " ")).alias("n_tokens"))


@query("s3_csv_header", sql="select source as label, md5(text) as text_md5 from documents")
def s3_csv_header(spark, d):
    path = shared_dir(spark, "s3")
    X.write_csv_header(views.utt(spark, d), path)
    r = R.read_csv_header(spark, path, "text", "category")
    return r.select("label", F.md5("utterance").alias("text_md5"))


@query("s3_csv_custom_columns", sql="select p_type as label, p_name as utterance from part")
def s3_csv_custom_columns(spark, d):
    path = shared_dir(spark, "s3c")
    X.write_csv_header(views.part_utt(spark, d), path, text_col="1", label_col="0")
    return R.read_csv_header(spark, path, "1", "0").select("label", "utterance")


@query("s4_json_pairs", sql=f"""
with s as (select p_type as label, p_name as utterance, CAST({HINT('p_partkey')} % 3 AS INTEGER) as split_no from part),
n as (select split_no, count(*) as n from s group by split_no)
select label, utterance, ['val', 'test', 'train'][split_no + 1] as split,
       CAST(coalesce((select sum(n) from n b where b.split_no < s.split_no), 0) AS BIGINT) as split_from,
       CAST((select sum(n) from n b where b.split_no <= s.split_no) AS BIGINT) as split_to
from s
""")
def s4_json_pairs(spark, d):
    path = shared_dir(spark, "s4")
    X.write_json_pairs(views.part_utt(spark, d), path)
    r = R.with_ord(R.read_json_pairs(spark, path), keys=("ord_key",))
    # the splits follow each other over the whole input, whatever file a row is in
    ends = r.groupBy("split").agg(F.min("ord").alias("split_from"), (F.max("ord") + 1).alias("split_to"))
    return r.join(F.broadcast(ends), "split").select("label", "utterance", "split", "split_from", "split_to")


@query("s5_json_struct", sql="select role as label, md5(text) as text_md5 from conversations")
def s5_json_struct(spark, d):
    path = shared_dir(spark, "s5")
    X.write_json_examples(views.conv(spark, d), path)
    return R.read_json_examples(spark, path).select("label", F.md5("utterance").alias("text_md5"))


@query("s4_json_documents", sql=f"""
select p_type as label, p_name as utterance, ['val', 'test', 'train'][CAST({HINT('p_partkey')} % 3 AS INTEGER) + 1] as split from part
""")
def s4_json_documents(spark, d):
    """One document per file, over many lines, read in splits."""
    path = shared_dir(spark, "s4d")
    x = views.part_utt(spark, d).withColumn("no", (hash_int("uid") % 3).cast("int")).withColumn("chunk", (hash_int("uid") % 4).cast("int"))
    lists = [F.collect_list(F.when(F.col("no") == i, F.array("utterance", "label"))).alias(s) for i, s in enumerate(("val", "test", "train"))]
    X.write_documents(x.groupBy("chunk").agg(*lists).select("chunk", F.struct("val", "test", "train").alias("doc")), path)
    return R.read_json_pairs(spark, path, multi_line=True).select("label", "utterance", "split")


@query("s5_json_documents", sql="select role as label, md5(text) as text_md5 from conversations")
def s5_json_documents(spark, d):
    """One document per file, over many lines, read in splits."""
    path = shared_dir(spark, "s5d")
    x = views.conv(spark, d).withColumn("chunk", (F.crc32(F.col("utterance").cast("binary")) % 4).cast("int"))
    examples = F.collect_list(F.struct(F.col("utterance").alias("text"), F.col("label").alias("intent"))).alias("common_examples")
    X.write_documents(x.groupBy("chunk").agg(examples).select("chunk", F.struct(F.struct("common_examples").alias("rasa_nlu_data")).alias("doc")), path)
    return R.read_json_examples(spark, path, multi_line=True).select("label", F.md5("utterance").alias("text_md5"))


@query("s7_json_documents", sql=f"select word, round({VSUM('vec')}, 6) as vec_sum from ({TOK_VEC})")
def s7_json_documents(spark, d):
    """One array per file, over many lines, read in splits."""
    from intentloom.functions import vectors as V
    path = shared_dir(spark, "s7d")
    x = views.tok_vec(spark, d).withColumn("chunk", (hash_int("word") % 3).cast("int"))
    X.write_documents(x.groupBy("chunk").agg(F.collect_list(F.struct("word", "vec")).alias("doc")), path)
    return R.read_word_vectors_json(spark, path, multi_line=True).select("word", F.round(V.vsum("vec"), 6).alias("vec_sum"))


@query("s1_quarantine", sql=f"""
select label, count(*) filter (h % 9 <> 0) as n_rows, count(*) filter (h % 9 = 0) as n_rejects
from (select p_type as label, {HINT('p_partkey')} as h from part) group by label
""")
def s1_quarantine(spark, d):
    """Rows with a field too many go to the rejects, all others are read."""
    path = shared_dir(spark, "s1q")
    bad = F.when(hash_int("uid") % 9 == 0, F.lit("\tone more")).otherwise(F.lit(""))
    views.part_utt(spark, d).select(F.concat("label", F.lit("\t"), "utterance", bad).alias("value")).write.text(path)
    rows, rejects = R.read_tsv_checked(spark, path)
    both = rows.select("label", F.lit(0).alias("bad")).unionByName(rejects.select(F.split_part("record", F.lit("\t"), F.lit(1)).alias("label"), F.lit(1).alias("bad")))
    return both.groupBy("label").agg(F.count_if(F.col("bad") == 0).alias("n_rows"), F.count_if(F.col("bad") == 1).alias("n_rejects"))


@query("s6_label_list", sql=f"""
select label, CAST(row_number() over (order by label) - 1 AS INTEGER) as label_id from (select distinct label from ({UTT}))
""")
def s6_label_list(spark, d):
    path = shared_dir(spark, "s6")
    X.write_label_list(L.distinct_labels(views.utt(spark, d)), path)
    return L.label_ids(R.read_label_list(spark, path))


@query("s7_word_vectors", sql=f"""
select word, CAST(row_number() over (order by word) - 1 AS INTEGER) as word_id, round({VSUM('vec')}, 6) as vec_sum
from ({TOK_VEC})
""")
def s7_word_vectors(spark, d):
    path = shared_dir(spark, "s7")
    X.write_word_vectors_json(views.tok_vec(spark, d), path)
    from intentloom.functions import vectors as V
    r = R.read_word_vectors_json(spark, path)
    return r.select("word", "word_id", F.round(V.vsum("vec"), 6).alias("vec_sum"))


@query("s8_word2vec_text", sql=f"""
select word, CAST(row_number() over (order by word) - 1 AS INTEGER) as word_id, round({VSUM('vec')}, 6) as vec_sum
from ({TOK_VEC})
""")
def s8_word2vec_text(spark, d):
    path = shared_dir(spark, "s8")
    X.write_word2vec_text(views.tok_vec(spark, d), path)
    from intentloom.functions import vectors as V
    r = R.read_word2vec_text(spark, path)
    return r.select("word", "word_id", F.round(V.vsum("vec"), 6).alias("vec_sum"))


@query("s9_folds", sql=f"""
select CAST({HINT('p_partkey')} % 10 + 1 AS INTEGER) as fold, p_type as label, count(*) as n from part group by all
""")
def s9_folds(spark, d):
    path = shared_dir(spark, "s9")
    K.write_folds(views.part_utt(spark, d), path)
    r = R.read_folds(spark, path)
    return r.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@query("s10_split_sink", sql=f"""
with sp as ({SPLIT(UTT)})
select 'test_joint' as part_read, label, count(*) as n from sp where part in ('test_seen', 'test_novel') group by all
union all select 'support_joint', label, count(*) from sp where part in ('support_seen', 'support_novel') and k = 5 group by all
union all select part, label, count(*) from sp where k = 0 group by all
""")
def s10_split_sink(spark, d):
    path = shared_dir(spark, "s10")
    sp, _ = split_build.build(views.utt(spark, d))
    K.write_split(sp, path)
    tj = K.read_split(spark, path, "test_joint").groupBy(F.lit("test_joint").alias("part_read"), "label").count()
    sj = K.read_split(spark, path, "support_joint", k=5).groupBy(F.lit("support_joint").alias("part_read"), "label").count()
    dp = K.read_split(spark, path, k=0).groupBy(F.col("part").alias("part_read"), "label").count()
    return tj.unionByName(sj).unionByName(dp).withColumnRenamed("count", "n")


@query("s11_sweep_sink", sql=f"""
with sp as ({SPLIT(UTT)}),
rk as (select uid, rn, floor(CAST(n * 2 AS DOUBLE) / 3.0) as tt from ({RANKED(f"select d.* from ({DEDUP(UTT)}) d")})),
w as (select p.pct, sp.part from sp join rk using (uid), (select unnest([20, 40, 60, 80, 100]) as pct) p
      where sp.part <> 'train_seen' or rk.rn <= floor(CAST(p.pct * rk.tt AS DOUBLE) / 100.0))
select CAST(pct AS INTEGER) as pct, part, count(*) as n from w group by all
""")
def s11_sweep_sink(spark, d):
    path = shared_dir(spark, "s11")
    u = views.utt(spark, d)
    sp = S.split_sets(L.dedup_last_wins(u), split_build.roles_of(u), keep_rank=True)
    sweep = W.seen_fraction_sweep(sp).drop("utterance")
    K.write_split(sweep, path, partition_by=("pct", "part"))
    # Rewrite one step only; dynamic partition overwrite keeps the others
    K.write_split(sweep.where(F.col("pct") == 100), path, partition_by=("pct", "part"))
    r = spark.read.parquet(path)
    return r.groupBy(F.col("pct").cast("int").alias("pct"), "part").agg(F.count(F.lit(1)).alias("n"))


@query("s11_label_space_sink", sql=f"""
with sp as ({SPLIT(UTT)}), {LS_STEPS}
select CAST(steps.pct AS INTEGER) as pct, sp.part, sp.label, count(*) as n from sp join steps using (label) group by all
""")
def s11_label_space_sink(spark, d):
    path = shared_dir(spark, "s11-labels")
    sp, roles = split_build.build(views.utt(spark, d), columns=("uid", "label", "role", "part", "k"))
    K.write_split(W.label_space_sweep(sp, roles), path, partition_by=("pct", "part"))
    r = spark.read.parquet(path)
    return r.groupBy(F.col("pct").cast("int").alias("pct"), "part", "label").agg(F.count(F.lit(1)).alias("n"))


@query("s11_shots_sink", sql=f"""
select part, k, label, count(*) as n from ({SPLIT(UTT, shots=(1, 5, 10, 20))}) where k in (5, 20) group by all
""")
def s11_shots_sink(spark, d):
    """The shots sweep is written, then rewritten whole with two of its K; the others are gone."""
    path = shared_dir(spark, "s11-shots")
    sp, _ = split_build.build(views.utt(spark, d), shots=W.SHOT_STEPS, columns=("uid", "label", "role", "part", "k"), materialized=True)
    sweep = W.shots_sweep(sp)
    K.write_split(sweep, path)
    K.write_split(sweep.where(F.col("k").isin(5, 20)), path, dynamic=False)
    r = spark.read.parquet(path)
    return r.groupBy("part", F.col("k").cast("int").alias("k"), "label").agg(F.count(F.lit(1)).alias("n"))
