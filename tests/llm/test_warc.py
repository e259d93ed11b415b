"""WARC round trips: exact payloads, revisits, magic inside payloads, many splits."""

import base64
import hashlib

import pytest

from intentloom.llm.warc import MAGIC, candidates, read_warc, round_trip, write_warc
from intentloom.session import shared_dir

FAKE = f"{MAGIC}WARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expected(rows, least):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        f = first.get(p)
        old = f is not None and f < (1 << 63 if i is None else i)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if old else "response", f if old else None))
    return sorted(out, key=repr)


def pages():
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 50)) for i in range(300)]
    rows += [(1000, "http://x\r\nEvil: 1", FAKE), (1001, None, FAKE * 5), (1002, "u", "x" * 30000 + FAKE + "y" * 9000),
             (1003, "u", None), (1004, "u", ""), (1005, "u", "\r\n\r\n"), (1006, "u", "tail\r\n"), (1007, "u", "é" * 500 + MAGIC),
             (1008, "u", f"{MAGIC}Content-Length: 99999999\r\n\r\n"), (1009, "u", MAGIC[:5]), (None, "u", FAKE), (1010, "u", "z" * 50000)]
    return rows


@pytest.mark.parametrize("least,split,compression", [(0, "4k", "none"), (100, "128m", "none"), (0, "1k", "gzip")])
def test_round_trip(spark, least, split, compression):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "page_id long, url string, html string, payload int, digest string").repartition(3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = round_trip(df, least, compression).drop("file", "offset").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, least)


def test_candidates_outnumber_records(spark):
    path = shared_dir(spark, "warc-test")
    write_warc(spark.createDataFrame([(1, "u", FAKE + "a" + FAKE)], "page_id long, url string, html string"), path)
    assert candidates(spark, path).filter("succ is not null").count() == 3
    assert [r.page_id for r in read_warc(spark, path).collect()] == [1]


def test_truncated_file(spark, tmp_path):
    path = shared_dir(spark, "warc-cut")
    write_warc(spark.createDataFrame([(1, "u", "hello"), (2, "u", "w" * 100)], "page_id long, url string, html string").coalesce(1), path)
    import glob
    import os
    part = glob.glob(path.removeprefix("file:") + "/part-*")[0]
    data = open(part, "rb").read()
    out = tmp_path / "cut.warc"
    out.write_bytes(data[:-20])
    got = {r.page_id: r.payload_digest for r in read_warc(spark, str(out)).collect()}
    assert got[1] is not None and got[2] is None and os.path.getsize(out) == len(data) - 20


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert round_trip(empty).count() == 0


def test_hot_payloads_beside_others(spark, monkeypatch):
    import intentloom.llm.warc as m
    monkeypatch.setattr(m, "_HOT", 4)
    rows = [(i, "u", "hot") for i in range(5, 400)] + [(1000 + i, "u", f"pair {i // 2}") for i in range(200)] + [(2000 + i, "u", f"own {i}") for i in range(50)]
    rows += [(None, "u", "hot"), (None, None, "pair 3"), (3000, "u", None), (3001, "u", ""), (3, "u", "own 7")]
    got = m.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = sorted(((i, h or "", least.get(h or "") if least.get(h or "") is not None and (i is None or least[h or ""] < i) else None) for i, _, h in rows), key=repr)
    assert sorted(((r.page_id, r.payload, r.refers_to) for r in got), key=repr) == want
