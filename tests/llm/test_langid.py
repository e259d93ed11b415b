"""Language identification: held-out accuracy, backoff, texts without letters."""

import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from intentloom.llm.langid import Classifier, held_out, identify, learn, letters, sample, score_word
from intentloom.llm.queries import op6
from tests.conftest import SF_SMALL


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = op6(spark, SF_SMALL).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and r.lang and len(letters(r.text or "")) >= 5]
    assert sum(r.lang_pred == r.lang for r in judged) >= 0.97 * len(judged)


def model(spark):
    rows = [("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind nicht hier", "de"), ("le chat est sur la table", "fr")]
    rows += [(None, "en"), ("words without a language", None), ("", "fr")]
    return learn(spark.createDataFrame([(t, lang, 1) for t, lang in rows for _ in range(3)], "text string, lang string, n int"))


def test_words_first_then_shorter_ngrams(spark):
    m = model(spark)
    assert m["langs"] == ["de", "en", "fr"]
    tables = m["tables"]
    assert score_word(m, "katze") == (tables[0].get("katze"), 1)
    assert "katzen" not in tables[0] and score_word(m, "katzen")[1] == sum(g in tables[5] for g in (" katz", "katze", "atzen", "tzen "))
    assert score_word(m, "zz") == (tuple(2 * x for x in tables[1].get("z")), 2)
    assert score_word(m, "жж") == ((), 0)


def test_defined_results(spark):
    m = model(spark)
    rows = [(1, None), (2, ""), (3, "12 34 !? ½ ²"), (4, "жжж"), (5, "die katze"), (5, "die katze"), (None, "le chat"), (7, "the cat " * 50000)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, other double")
    got = {(r.doc_id): (r.lang_pred, r.score) for r in identify(df, m).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in m["langs"] and got[5][0] == "de" and got[None][0] == "fr" and got[7] == ("en", 1.0)
    assert identify(df.limit(0), m).count() == 0
    nothing = learn(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}


def test_memory_is_bounded(spark):
    c = Classifier(model(spark))
    c.most = 10
    c._forget(0)
    assert c(" ".join(f"katze{chr(97 + i)}" for i in range(26)))[0] == "de"
    assert c("the cat")[0] == "en" and len(c.rows) <= 26 + 10


def test_null_id_is_not_held_out(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out().alias("h"), F.lit(1)).first().h == (zlib.crc32(b"") % 3 == 1)


def plain_model(rows):
    """Counts per (order, language) from different texts; order 0 are words."""
    counts = {}
    for lang, text in {(lang, t) for lang, t in rows if lang and t}:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            w = "".join(c for c in word if c.isalpha())
            for n in range(6 if w else 0):
                grams = [w] if n == 0 else list(w) if n == 1 else [f" {w} "[i:i + n] for i in range(len(w) + 3 - n)]
                counts.setdefault((n, lang), Counter()).update(grams)
    return counts


def plain_predict(counts, text):
    langs = sorted({lang for _, lang in counts})
    known = lambda n, g: any(g in counts.get((n, lang), ()) for lang in langs)
    log = lambda n, lang, g: math.log((counts.get((n, lang), Counter())[g] + 0.5) / (sum(counts.get((n, lang), Counter()).values()) + 1))
    total, some = dict.fromkeys(langs, 0.0), False
    for word, times in Counter(re.findall(r"[^\W\d_]+", (text or "").lower())).items():
        w = "".join(c for c in word if c.isalpha())
        some |= bool(w)
        parts = [(0, w)] if known(0, w) else []
        for n in (5, 4, 3, 2, 1):
            if not parts and w:
                grams = list(w) if n == 1 else [f" {w} "[i:i + n] for i in range(len(w) + 3 - n)]
                parts = [(n, g) for g in grams if known(n, g)]
        for lang in langs if parts else ():
            total[lang] += times * sum(log(n, lang, g) for n, g in parts) / len(parts)
    if not some or not langs:
        return "und", 0.0
    best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp(max(total[x] - total[best], -700)) for x in langs)


def test_whole_table_equals_the_plain_model(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    learned = [(r.lang, r.text) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    counts = plain_model(learned)
    texts = {r.doc_id: r.text for r in docs}
    for r in op6(spark, SF_SMALL).collect():
        lang, score = plain_predict(counts, texts[r.doc_id])
        assert (r.lang_pred, round(r.score, 6)) == (lang, round(score, 6)), r.doc_id


def test_copies_do_not_hide_a_language(spark):
    rows = [(f"the text number {i % 3} of few", "en") for i in range(1500)] + [("le chat est ici", "fr")] * 900 + [(f"ein wort und {i} mehr {chr(97 + i % 26)}x", "de") for i in range(400)]
    for shift in range(4):
        df = spark.createDataFrame([(f"{t} {shift}", lang) for t, lang in rows], "text string, lang string").repartition(3)
        drawn = sample(df, 100)
        assert {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()} == {"en": 3, "fr": 1, "de": 100}
    assert learn(df, 100)["langs"] == ["de", "en", "fr"]


def test_ties_go_to_the_first_language(spark):
    m = learn(spark.createDataFrame([("aa bb", "zz"), ("aa bb", "yy"), ("aa bb", None)], "text string, lang string"))
    got = identify(spark.createDataFrame([("aa bb cc",)], "text string"), m).first()
    assert got.lang_pred == "yy" and abs(got.score - 0.5) < 1e-12
