"""Proofs for dataset presets: write a layout from the test tables (in a known
order), build the dataset split through the preset."""

from __future__ import annotations

from intentloom.functions.order import hash_int
from intentloom.plans import datasets as DS
from intentloom.registry import query
from intentloom.registry.sqlparts import DEDUP, HINT, SPLIT
from intentloom.session import shared_dir
from intentloom.sources import exporters as X
from intentloom.sources import views

# files are written in key order, so ord = position in that order
PART_ORD = ("select CAST(row_number() over (order by p_partkey) - 1 AS BIGINT) as uid, p_name as utterance, "
            "p_type as label, CAST(row_number() over (order by p_partkey) - 1 AS BIGINT) as ord from part")
DOC_ORD = ("select CAST(row_number() over (order by doc_id) - 1 AS BIGINT) as uid, text as utterance, "
           "source as label, CAST(row_number() over (order by doc_id) - 1 AS BIGINT) as ord from documents")
ATIS_DEDUP = (f"select * from ({DEDUP(DOC_ORD)}) where label in "
              f"(select label from ({DEDUP(DOC_ORD)}) group by label having count(*) >= 10)")


@query("ds_custom_csv", sql=f"select uid, label, role, part, k from ({SPLIT(PART_ORD, pct=33, shots=(5,), num=1, den=2)})")
def ds_custom_csv(spark, d):
    path = shared_dir(spark, "ds-custom")
    X.write_csv_header(views.part_utt(spark, d).orderBy("uid"), path, text_col="1", label_col="0")
    sp, _ = DS.build_dataset(spark, "custom", [path], shots=(5,))
    return sp.select("uid", "label", "role", "part", "k")


@query("ds_atis_json", sql=f"""
select uid, label, role, part, k from ({SPLIT(DOC_ORD, m=4, roles_src=ATIS_DEDUP, dedup=ATIS_DEDUP)})
""")
def ds_atis_json(spark, d):
    path = shared_dir(spark, "ds-atis")
    X.write_json_examples(views.utt(spark, d), path, rows_per_chunk=97, order="uid")
    sp, _ = DS.build_dataset(spark, "atis", [path], multi_line=False)
    return sp.select("uid", "label", "role", "part", "k")


# the splits follow each other (val, test, train), and last-wins dedup sees them in that order
CLINC_ORD = (f"select * replace (row_number() over (order by no, p_partkey) - 1 as uid), row_number() over (order by no, p_partkey) - 1 as ord "
             f"from (select 0 as uid, p_name as utterance, p_type as label, p_partkey, {HINT('p_partkey')} % 3 as no from part)")
BANKING_ORD = CLINC_ORD.replace(" % 3 as no", " % 2 as no")


@query("ds_clinc150", sql=f"select uid, label, role, part, k from ({SPLIT(CLINC_ORD, m=50)})")
def ds_clinc150(spark, d):
    path = shared_dir(spark, "ds-clinc")
    X.write_json_pairs(views.part_utt(spark, d), path, rows_per_chunk=97, order="uid")
    sp, _ = DS.build_dataset(spark, "clinc150", [path], shots=(1, 5), multi_line=False)
    return sp.select("uid", "label", "role", "part", "k")


@query("ds_banking77", sql=f"select uid, label, role, part, k from ({SPLIT(BANKING_ORD, m=27)})")
def ds_banking77(spark, d):
    """Two files, train before test."""
    u = views.part_utt(spark, d)
    paths = [shared_dir(spark, f"ds-banking-{i}") for i in (0, 1)]
    for i, p in enumerate(paths):
        X.write_csv_header(u.where(hash_int("uid") % 2 == i).orderBy("uid"), p)
    sp, _ = DS.build_dataset(spark, "banking77", paths, shots=(1, 5))
    return sp.select("uid", "label", "role", "part", "k")
