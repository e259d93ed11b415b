"""The pipeline, stage by stage against brute force, on the small table and on odd rows."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.conftest import SF_SMALL
from tests.llm.test_jaccard_join import brute as near
from tests.llm.test_suffix_dedup import brute as windows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "jaccard_join", "suffix_array_dedup", "mixing", "packing"] and cp.ORACLE_SQL is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    one = cp.language_id(spark, docs, SF_SMALL).cache()
    assert one.columns == COLUMNS
    kept = {r.doc_id: r.text for r in one.collect()}
    clean = {d: t for d, t in rows if len(re.findall(r"[^\W\d_]{2,}", t or "")) >= 20}
    assert set(clean) <= set(kept) and all(kept[d] == t for d, t in clean.items())

    two = cp.jaccard_join(spark, one, SF_SMALL).cache()
    assert two.columns == COLUMNS
    want = {d for d, c, _ in near(sorted(kept.items())) if d == c}
    assert sorted(r.doc_id for r in two.collect()) == sorted(want)

    three = cp.suffix_array_dedup(spark, two, SF_SMALL).cache()
    assert three.columns == COLUMNS
    left = {d: n - gone for d, n, gone, _, _ in windows([(d, kept[d]) for d in want])}
    got = {r.doc_id: r for r in three.collect()}
    assert all(len(r.text.encode()) <= left[d] <= len(r.text.encode()) + 6 * 10 for d, r in got.items())
    assert all(r.n_chars == len(r.text) for r in got.values()) and all(left[d] < 100 for d in set(left) - set(got))

    four = cp.mixing(spark, three, SF_SMALL).cache()
    assert four.columns == COLUMNS
    have, total = {}, sum(len(WORDS.findall(r.text)) for r in got.values())
    for r in four.collect():
        n, size = len(WORDS.findall(r.text)), len(WORDS.findall(got[r.doc_id].text))
        assert 0 < n <= 2 * size and set(WORDS.findall(r.text)) <= set(WORDS.findall(got[r.doc_id].text))
        have[r.doc_id] = n
    assert abs(sum(have.values()) - 1.5 * total) < 0.02 * total

    five = cp.packing(spark, four, SF_SMALL).collect()
    assert {r.doc_id for r in five} == set(have)
    full = {}
    for r in five:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert max(full.values()) <= 2048 and len(full) <= sum(full.values()) / 2048 * 1.02 + 2


def test_odd_rows_and_empty(spark):
    text = "the cat and the dog sat on the mat " * 8
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + "here and now", "en", None, 3),
            (4, "1234 !!", "en", "s", 7), (5, "der hund und die katze " * 9, "de", None, 9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, carry int, sid string")
    docs = df
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == df.columns
    assert {r.doc_id for r in docs.collect()} >= {1, 5} and cp.packing(spark, docs, SF_SMALL).count() >= 2
    docs = df.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0


def test_run(spark):
    got = cp.run(spark, SF_SMALL)
    assert got.select("doc_id", "piece", "sequence_id", "offset").filter(F.col("length") > 2048).count() == 0 and got.count() > 0


HELPERS = ("row kept th doc tag carry lo hi spans repeat first score lang_pred n_bytes n_removed n_spans kept_sha256 _th _doc _text _size _passes _from1 size "
           "passes from1 to1 from2 to2 took_id took_th taken target source_size sid class_id n_links n_set_links n_shingles piece start length ids_crc32 "
           "sequence_id offset bin_group quota shard seats n copies embed node run parent lang_rank r h").split()


def test_any_extra_columns(spark):
    rows = [(1, "the cat and the dog sat on the mat " * 8, "en", "s", 1), (2, "der hund und die katze " * 9, "de", None, 9), (None, "le chat est sur la table et " * 9, "fr", "s", 3)]
    rows += [(10 + i, " ".join(f"word{chr(97 + (i * j) % 26)}{chr(97 + j % 26)}" for j in range(80)), "en", "s", 0) for i in range(30)]
    odd = [*HELPERS, "a.b", "with space"]
    df = spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in odd)) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in odd))
    docs = df
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == df.columns
        got = docs.collect()
        assert len(got) >= 10 and all(r[c] == f"{c}-{r.doc_id}" for r in got for c in odd) and all(r.n_chars == len(r.text) or r.text in [x[1] for x in rows] for r in got)
    assert cp.packing(spark, docs, SF_SMALL).count() >= 10
