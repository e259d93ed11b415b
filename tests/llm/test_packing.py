"""Best-two-fit packing: exact ids, gapless sequences, few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from intentloom.llm.packing import best_two_fit, encoder, pack, sequences, token_ids
from intentloom.session import checkpoint_root
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n\t ", "<|endoftext|> is text", "don't we'll I'M", "é" * 300, "日本語 テキスト", "🙂👍🏽 z\u200dj", "a" * 5000, "x\u00a0y\u3000z",
       "1234567890 ½²", "\x00\x01\x7f", "word " * 3000, "ñandú\r\n\r\n  two  spaces   three"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizers_library(spark, reference):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()] + [t or "" for t in ODD]
    enc = encoder(PATH)
    assert [enc.encode_ordinary(t) for t in texts] == reference(texts)


def test_pack(spark, reference):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, length int, bin_group string").repartition(5)
    packed = pack(df, PATH, keep_ids=True)
    got = packed.collect()
    ids = {}
    for (d, t), x in zip(rows, reference([t or "" for _, t in rows])):
        ids[d] = np.array([*x, 0], "<u4")
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and bytes(r.ids) == part.tobytes()
    for d, pieces in by_doc.items():
        if d == 3:
            assert len(pieces) == 2 * len({p.piece for p in pieces})
            continue
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(ids[d]) and all(p.length == 2048 for p in pieces[1:]) and pieces[0].length <= 2048
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(q.length for q in s[:i]) for i in range(len(s))] and sum(r.length for r in s) <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(by_seq) <= least * 1.02 + 2
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()}
    assert all(whole[k] == b"".join(bytes(r.ids) for r in s) for k, s in by_seq.items())


def test_two_replace_the_smallest():
    # greedily 6 + 3 leaves a gap of 1; 2 + 2 in place of 3 fills it
    bins = best_two_fit([6, 3, 2, 2], 10)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]


@pytest.mark.parametrize("seed", range(4))
def test_every_row_once_and_tight(seed):
    rnd = random.Random(seed)
    n = [min(2048, int(rnd.expovariate(1 / 500)) + 1) for _ in range(3000)]
    bins = best_two_fit(n, 2048)
    assert sorted(r for b in bins for r in b) == list(range(3000)) and all(sum(n[r] for r in b) <= 2048 for b in bins)
    assert len(bins) <= -(-sum(n) // 2048) * 1.01 + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_queries_have_the_default_ids(spark, tmp_path):
    import corpus_pipeline
    from intentloom.llm.queries import op10
    plain = Tokenizer.from_file(PATH)
    texts = [*ODD, "a <|endoftext|> is text", "<|endoftext|><|endoftext|>", "  <|endoftext|>  \n", "<|endoftext |> <|ENDOFTEXT|>", "x<|endoftext|>y" * 3000]
    texts += [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    ids = [np.array([*x.ids, 0], "<u4") for x in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert list(ids[len(ODD)]) == [64, 220, 50256, 318, 2420, 0]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (op10(spark, str(tmp_path)).collect(), corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()):
        assert sum(r.length for r in got) == sum(map(len, ids))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) for r in got)


@pytest.mark.parametrize("n", [10_000, 1_000_000, 10_000_000])
@pytest.mark.parametrize("kind", [" ", "\n", "\t", " \n\t　\xa0", "\r\n"])
def test_long_blank_runs(n, kind):
    if n > 1_000_000 and kind not in (" ", "\n"):
        pytest.skip("one size more for the plain kinds only")
    run = (kind * n)[:n]
    for special in (False, True):
        t = Tokenizer.from_file(PATH)
        t.encode_special_tokens = special
        around = [run] if n > 1_000_000 else [run, "a" + run + "b", run + "1", "x " + run + "<|endoftext|>" + run + "'s", "é\x1c" + run + "\x1f!" + run]
        for text in around:
            assert np.array_equal(token_ids(PATH, text, special), t.encode(text, add_special_tokens=False).ids)


def test_blank_runs_through_the_query(spark):
    from intentloom.llm.queries import QUERIES
    rows = [(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_000 + "b"), (3, "few words"), (None, "\t" * 300_000)]
    folder = checkpoint_root(spark) + "/blank-runs"
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    t = Tokenizer.from_file(PATH)
    got = QUERIES["op10_best_two_fit"](spark, folder).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in rows}


def plain_two_fit(lengths, capacity):
    """Lengths per bin: fill with the longest that fits, then trade the smallest for the best two, while that helps."""
    stock, bins = sorted(lengths), []
    while stock:
        held, room = [], capacity
        while fits := [x for x in stock if x <= room]:
            held.append(fits[-1])
            stock.remove(fits[-1])
            room -= fits[-1]
        while room and held:
            space = room + min(held)
            sums = [(stock[i] + stock[j], -i) for i in range(len(stock)) for j in range(i + 1, len(stock)) if stock[i] + stock[j] <= space]
            if not sums or max(sums)[0] <= min(held):
                break
            total = max(sums)[0]
            pair = next((a, total - a) for a in stock if total - a in stock and (a != total - a or stock.count(a) > 1))
            stock = sorted([*stock, min(held)])
            held.remove(min(held))
            for x in pair:
                stock.remove(x)
                held.append(x)
            room = space - total
        bins.append(sorted(held))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_packing_equals_the_plain_rule(seed):
    rng = random.Random(seed)
    capacity = rng.choice([50, 100, 2048])
    lengths = [rng.randint(1, rng.choice([capacity, capacity // 2, capacity // 5])) for _ in range(120)]
    got = [sorted(lengths[r] for r in b) for b in best_two_fit(lengths, capacity)]
    assert got == plain_two_fit(lengths, capacity)
