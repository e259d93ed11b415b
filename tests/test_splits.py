"""Documents cut into many splits give the rows of a reader that takes each file whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from intentloom.sources import readers as R
from intentloom.sources import splits as SP

ODD = ['say "hi"', "a]b", "x}, {y", 'end\\', "[[", '\\"]', "é 漢\U0001F600", "", " \t", "line\nbreak", '"]}', "null", "{", 'a\\\\"b', " "]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def texts(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice(ODD) + " word" * rnd.randrange(6) + rnd.choice(ODD) for _ in range(n)]


def tasks_of(spark, path, sep):
    return SP._pieces(spark, path, sep).select("__file", "__block").distinct().count()


@pytest.mark.parametrize("indent", [None, 2])
def test_json_documents(spark, tmp_path, small_splits, indent):
    pairs = {s: [[t, f"l{i % 5}"] for i, t in enumerate(texts(s, n))] for s, n in (("train", 90), ("val", 0), ("extra", 7), ("test", 40))}
    examples = [{"text": t, "intent": f"i{i % 4}", "entities": [{"start": i, "v": [1, {"d": "]"}]}] if i % 3 else []} for i, t in enumerate(texts(5, 90))]
    rasa = {"rasa_nlu_data": {"regex_features": [{"text": "no", "intent": "no"}], "common_examples": examples, "entity_synonyms": [{"text": "no"}], "n": 3}}
    words = [{"word": w, "vec": [i / 4, -1.5, 1e-3]} for i, w in enumerate(texts(6, 80))]
    for name, doc in (("pairs", pairs), ("rasa", rasa), ("words", words)):
        for part in range(2):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"{part}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=part == 0), encoding="utf-8")
        assert tasks_of(spark, str(tmp_path / name), "]") > 6
    want = [(s, t, x) for s in R.JSON_SPLIT_ORDER for _ in range(2) for t, x in pairs[s]]
    got = R.with_ord(R.read_json_pairs(spark, str(tmp_path / "pairs"), multi_line=True), keys=("ord_key",)).orderBy("ord").collect()
    assert [(r.split, r.utterance, r.label) for r in got] == want
    got = R.with_ord(R.read_json_examples(spark, str(tmp_path / "rasa"), multi_line=True), keys=("ord_key",)).orderBy("ord").collect()
    assert [(r.utterance, r.label) for r in got] == [(e["text"], e["intent"]) for e in examples] * 2
    got = R.read_word_vectors_json(spark, str(tmp_path / "words"), multi_line=True).orderBy("word_id").collect()
    assert [r.word for r in got] == [w["word"] for w in words] * 2 and got[5].vec[1] == -1.5
    assert R.read_word_vectors_json(spark, str(tmp_path / "words"), nmax=9, multi_line=True).count() == 10


def test_empty_and_small_documents(spark, tmp_path):
    for i, doc in enumerate(('{"train": [], "val": [["a","b"]]}', "{}", "", '{"train":[["x","y"]]}')):
        (tmp_path / f"{i}.json").write_text(doc)
    got = R.read_json_pairs(spark, str(tmp_path), multi_line=True).collect()
    assert sorted((r.split, r.utterance, r.label) for r in got) == [("train", "x", "y"), ("val", "a", "b")]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_with_quoted_newlines(spark, tmp_path, small_splits, newline):
    rnd = random.Random(3)
    cell = lambda t: '"' + t.replace('"', '""') + '"' if rnd.random() < 0.6 or any(c in t for c in '",\r\n') else t
    rows = [(rnd.choice(["plain words", 'he said "no"', "two\nlines", '\n"\n', '""', "a,b\n\n,c", 'x"y', '5" disk', "é漢", 'end"']) + f" {i}", f"c{i % 7}") for i in range(300)]
    body = ["text,category"] + [f'{t},{c}' if t.startswith('5" ') else f"{cell(t)},{cell(c)}" for t, c in rows]
    for part in range(2):
        (tmp_path / f"{part}.csv").write_text(newline.join(body) + (newline if part else ""), encoding="utf-8", newline="")
    got = R.read_csv_header(spark, str(tmp_path), ordered=True).orderBy("ord").select("utterance", "label")
    whole = R.with_ord(R.arrival_key(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path)))).orderBy("ord").select("text", "category")
    assert tasks_of(spark, str(tmp_path), "\n") > 10
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in whole.collect()]
    assert [tuple(r) for r in got.collect()] == rows * 2


def test_states_compose_over_splits(spark):
    rnd = random.Random(4)
    rows, state, want = [], False, {}
    for block in range(12):
        for row in range(rnd.choice([0, 1, 5])):
            f0, f1 = rnd.choice([(False, True), (True, False), (True, False), (False, False), (True, True)])
            rows.append(("f", block * 10, row, f0, f1, row + block))
            want["f", block * 10, row] = state
            state = f1 if state else f0
    df = spark.createDataFrame(rows, "__file string, __block long, __row long, __f0 boolean, __f1 boolean, v long").repartition(3)
    assert {(r["__file"], r["__block"], r["__row"]): r.s for r in SP.start_states(df, "s").collect()} == want
    total, sums = 0, {}
    for f, b, r, _, _, v in rows:
        sums[f, b, r] = total
        total += v
    assert {(r["__file"], r["__block"], r["__row"]): r.n for r in SP.running(df, "v", "n").collect()} == sums
    assert SP.running(df.where(F.lit(False)), "v", "n").count() == 0


def test_quarantine(spark, tmp_path, small_splits):
    lines = [f"l{i % 3}\tsome words {i}" for i in range(200)]
    lines[7], lines[50], lines[90], lines[150] = "a\tb\tc", '"x\ty"\t"two\nlines ""q"""', "only a label", 'l\t"q"\t'
    (tmp_path / "t.tsv").write_text("\n".join([*lines, "", "l\t\"never closed\nmore"]) + "\n")
    rows, rejects = R.read_tsv_checked(spark, str(tmp_path / "t.tsv"))
    assert rows.count() == 198 and {(r.label, r.utterance) for r in rows.collect()} >= {("x\ty", 'two\nlines "q"'), ("only a label", None)}
    assert sorted((r.record_no, r.n_fields) for r in rejects.collect()) == [(7, 3), (150, 3), (201, 2)]
    with pytest.raises(R.MalformedRows, match="3 malformed"):
        R.read_tsv_checked(spark, str(tmp_path / "t.tsv"), strict=True)
    (tmp_path / "c.csv").write_text('text,category,more\n"a, b",c\nx,y,z\n1,2,3,4\n')
    rows, rejects = R.read_csv_checked(spark, str(tmp_path / "c.csv"))
    assert sorted(map(tuple, rows.collect())) == [("c", "a, b"), ("y", "x")] and [r.record for r in rejects.collect()] == ["1,2,3,4"]
    (tmp_path / "j.json").write_text('{"val": [["a", "b"]]}\n{"val": [["a"\n{"train": []}\n')
    docs, rejects = R.read_json_checked(spark, str(tmp_path / "j.json"), "val ARRAY<ARRAY<STRING>>, train ARRAY<ARRAY<STRING>>")
    assert docs.count() == 2 and docs.columns == ["val", "train"] and [r.record for r in rejects.collect()] == ['{"val": [["a"']
