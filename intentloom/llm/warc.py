"""WARC archives: writing response and revisit records, and reading them back by
boundary-chain verification.

Writing: payloads are compared by SHA-1 and length; the smallest page_id of equal
payloads becomes the ``response``, the others ``revisit`` it.  Records go out as text
files (``WARC/1.1`` records closed by a blank line pair).

Reading: the files are split wherever Spark likes, with the magic line as the record
separator.  A magic inside a payload is therefore also a *candidate*.  Tasks emit
``(offset, successor)`` for every candidate, the successor from its own Content-Length.
A record is real only if it lies on the chain that starts at offset 0 of its file:

* inside a split, a task follows each candidate to the first successor beyond the split;
* between splits, pointer jumping doubles those exits, so a file of ``s`` splits takes
  ``ceil(log2(s))`` rounds;
* inside each split, the chain from the entry that is reached keeps the real records.

Real records whose payload was cut by a magic inside it (or by nothing: a truncated
file) are put together from the pieces between their offset and their successor.

Defined results: null html is an empty payload, a null url an empty target; payloads may
hold any text, also whole WARC records; null page_ids sort after all others; an empty
table writes no record; extra columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from intentloom.llm.common import stored, whole_groups
from intentloom.session import shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
_HOT = 10_000
CELL = 1 << 22  # bytes of a cell, for putting cut records together


def _uuid(digest, kind: str, page_id):
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


@F.pandas_udf(StringType())
def _base32(hex_digest):
    return hex_digest.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, sha1, refers_to`` (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"),
                     F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("sha1"))
    # partial aggregation: one row per task and payload; only payloads that occur again are joined
    # and with their size known from the files, so a small table needs no shuffle of payloads
    first = stored(p.filter(F.col("payload_bytes") >= min_bytes)
                   .groupBy(F.col("sha1").alias("_sha1"), F.col("payload_bytes").alias("_bytes"))
                   .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1"), "warc-repeated")
    # payloads that hold more than one in _HOT of those rows, so at most that many, are broadcast; their pages are then dealt by page
    hot = F.col("n") > (first.agg(F.sum("n")).first()[0] or 0) // _HOT
    often = first.filter(hot).select(F.col("_sha1").alias("_hot"), F.col("_bytes").alias("_hot_bytes"), F.col("first_id").alias("_hot_id"))
    rows = p.join(F.broadcast(often), (F.col("sha1") == F.col("_hot")) & (F.col("payload_bytes") == F.col("_hot_bytes")), "left")
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id").cast("string"))))
    rows = rows.join(first.filter(~hot), (F.col("_key") == F.col("_sha1")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    earlier = F.coalesce("_hot_id", "first_id")
    return rows.withColumn("refers_to", F.when(earlier < F.coalesce("page_id", F.lit((1 << 63) - 1)), earlier)).select(*p.columns, "refers_to")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "none") -> None:
    """One WARC record per row of ``pages(page_id, url, html)`` into the archives below ``path``."""
    p = with_revisits(pages, min_bytes).withColumn("digest", _base32("sha1"))
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uuid(F.col("digest"), "record", F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _uuid(F.col("digest"), "record", F.col("refers_to"))),
            line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END)), body)
    # the text writer closes every value with its line separator
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


_CANDIDATES = ("file string, split long, rel long, size long, length long, need long, page_id string, record_type string, "
               "declared string, digest string, payload_bytes long, refers string, complete boolean")
_CANDIDATE_NAMES = [c.split()[0] for c in _CANDIDATES.split(", ")]


def _headers(head: bytes) -> dict:
    out = {}
    for line in head.split(b"\r\n"):
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("latin-1")
    return out


def _parse(piece: bytes):
    """Header fields and payload of the piece after a magic: (fields, header bytes, content length), or None."""
    cut = piece.find(b"\r\n\r\n")
    if cut < 0:
        return None
    fields = _headers(piece[:cut])
    length = fields.get("content-length", "")
    if not length.isdigit() or not length.isascii():
        return None
    return fields, cut + 4, int(length)


def _scan(batches):
    """Pieces of a split in their order -> candidates with places relative to the split.  The rows
    of one split are consecutive in a task."""
    magic = len(MAGIC)
    here, rel, at_start = None, 0, False
    for b in batches:
        rows = {n: [] for n in _CANDIDATE_NAMES}
        for piece, file, split in zip(b.column("piece"), b.column("file").to_pylist(), b.column("split").to_pylist()):
            piece = piece.as_buffer().to_pybytes() if piece.is_valid else b""
            if (file, split) != here:
                here, rel, at_start = (file, split), 0, split == 0
            lead = at_start  # before the first magic of a file: no record
            at_start = False
            parsed = None if lead else _parse(piece)
            # a piece stands for magic + piece; the first of a file for itself
            size = len(piece) + (0 if lead else magic)
            r = dict.fromkeys(_CANDIDATE_NAMES) | {"file": file, "split": split, "rel": rel, "size": size}
            if parsed:
                fields, head, length = parsed
                body = piece[head:head + length]
                r |= {"length": magic + head + length + 4, "need": length, "page_id": fields.get("x-page-id"),
                      "record_type": fields.get("warc-type"), "declared": fields.get("warc-payload-digest"),
                      "digest": base64.b32encode(hashlib.sha1(body).digest()).decode(), "payload_bytes": int(fields.get("x-payload-bytes") or length),
                      "refers": fields.get("x-refers-to-page"), "complete": len(body) == length}
            rel += size
            for k, v in r.items():
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)


_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in
                    (c.split() for c in _CANDIDATES.split(", "))])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("split")))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every candidate record below ``path`` with its absolute ``offset`` and successor ``succ`` (null: no header)."""
    found = stored(_pieces(spark, path).mapInArrow(_scan, _CANDIDATES), "warc-candidates")
    # where each split's first piece begins: the bytes of the splits before it in the file
    splits = found.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    base = splits.withColumn("base", F.coalesce(F.sum("bytes").over(
        W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("bytes")
    return (found.join(base, ["file", "split"]).withColumn("offset", F.col("base") + F.col("rel"))
            .withColumn("succ", F.col("offset") + F.col("length")).drop("base", "rel", "length"))


def _exits(batches):
    """Sorted candidates of whole splits -> the first place beyond the split that each leads to."""
    for t in whole_groups(batches, ["file", "split"]):
        file, split, off, succ = (t.column(c).to_pylist() for c in ("file", "split", "offset", "succ"))
        out, leads, end = [None] * len(off), {}, None
        for k in range(len(off) - 1, -1, -1):
            if k + 1 == len(off) or (file[k], split[k]) != (file[k + 1], split[k + 1]):
                leads, end = {}, off[k]
            leads[off[k]] = out[k] = leads.get(succ[k], succ[k] if succ[k] > end else None)
        yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(off, pa.int64()), pa.array(out, pa.int64())],
                                         names=["file", "offset", "exit"])


def _walk(batches):
    """Sorted candidates of whole splits, ``entry`` marking where the chain comes in -> the real records."""
    here, nxt = None, None
    for b in batches:
        keep = []
        for file, split, off, succ, entry in zip(*(b.column(c).to_pylist() for c in ("file", "split", "offset", "succ", "entry"))):
            if (file, split) != here:
                here, nxt = (file, split), None
            if entry:
                nxt = off
            keep.append(nxt == off and succ is not None)
            if keep[-1]:
                nxt = succ
        yield b.filter(pa.array(keep, pa.bool_())).drop_columns(["entry"])


def _in_splits(df: DataFrame) -> DataFrame:
    return df.repartition("file", "split").sortWithinPartitions("file", "split", "offset")


def reachable(cands: DataFrame) -> DataFrame:
    """The candidates on the chains that start at offset 0 of each file."""
    cands = cands.filter("succ is not null")
    sorted_ = _in_splits(cands)
    schema = cands.select("file", "offset").schema.add("exit", "long")
    # an entry is a candidate that some chain can come in by: hop from entry to entry
    hop = sorted_.select("file", "split", "offset", "succ").mapInArrow(_exits, schema).filter("exit is not null")
    most = cands.groupBy("file").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] or 1
    entries = cands.groupBy("file").agg(F.min("offset").alias("offset")).filter("offset = 0")
    rounds = math.ceil(math.log2(most)) if most > 1 else 0
    if rounds:
        hop = stored(hop, "warc-hops")
        for k in range(rounds):
            step = entries.join(hop, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
            entries = stored(entries.union(step).distinct(), "warc-entries")
            if k + 1 < rounds:
                far = hop.select(F.col("file").alias("f2"), F.col("offset").alias("o2"), F.col("exit").alias("exit2"))
                hop = stored(hop.join(far, (F.col("file") == F.col("f2")) & (F.col("exit") == F.col("o2")))
                             .select("file", "offset", F.col("exit2").alias("exit")), "warc-hops")
    marked = cands.join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left")
    cols = [*cands.columns, "entry"]
    return _in_splits(marked.select(*cols)).mapInArrow(_walk, cands.schema)


def _joined(batches):
    """Pieces of each cut record, in order -> its payload's digest (null: the file ends too soon)."""
    for b in batches:
        out = []
        for need, pieces in zip(b.column("need").to_pylist(), b.column("pieces").to_pylist()):
            whole = MAGIC.encode().join(p["piece"] for p in sorted(pieces, key=lambda p: p["at"]))
            cut = whole.find(b"\r\n\r\n") + 4
            body = whole[cut:cut + need]
            out.append(base64.b32encode(hashlib.sha1(body).digest()).decode() if len(body) == need else None)
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("offset"), pa.array(out, pa.string())], names=["file", "offset", "joined"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The real records below ``path``: ``file, offset, page_id, payload_bytes, payload_digest, record_type, refers_to``.

    ``payload_digest`` is computed from the payload read (revisits: as declared, they hold none);
    it is null where the file ends before the payload does.
    """
    cands = candidates(spark, path)
    real = stored(reachable(cands), "warc-records")
    cut = real.filter("not complete")
    if cut.limit(1).count():
        cells = cut.select("file", F.col("offset").alias("at"), "succ", "need", F.explode(F.sequence(
            F.floor(F.col("offset") / CELL), F.floor((F.col("succ") - 1) / CELL))).alias("cell"))
        inside = cands.select("file", "split", "offset", F.floor(F.col("offset") / CELL).alias("cell")).join(cells, ["file", "cell"]) \
            .filter("offset >= at and offset < succ").select("file", "split", "offset", "at", "need")
        base = cands.groupBy("file", "split").agg(F.min("offset").alias("base"))
        texts = (_pieces(spark, path).mapInArrow(_with_place, "file string, split long, rel long, piece binary")
                 .join(base, ["file", "split"]).select("file", (F.col("base") + F.col("rel")).alias("offset"), "piece"))
        joined = (texts.join(inside, ["file", "offset"])
                  .groupBy("file", F.col("at").alias("offset"), "need").agg(F.collect_list(F.struct(F.col("offset").alias("at"), "piece")).alias("pieces"))
                  .mapInArrow(_joined, "file string, offset long, joined string"))
        real = real.join(joined, ["file", "offset"], "left").withColumn("digest", F.when(F.col("complete"), F.col("digest")).otherwise(F.col("joined")))
    revisit = F.col("record_type") == "revisit"
    return real.select("file", "offset", F.expr("try_cast(page_id as bigint)").alias("page_id"), "payload_bytes",
                       F.when(revisit, F.regexp_replace("declared", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
                       "record_type", F.expr("try_cast(refers as bigint)").alias("refers_to"))


def _with_place(batches):
    magic = len(MAGIC)
    here, rel, at_start = None, 0, False
    for b in batches:
        place = []
        for n, file, split in zip(b.column("piece").to_pylist(), b.column("file").to_pylist(), b.column("split").to_pylist()):
            if (file, split) != here:
                here, rel, at_start = (file, split), 0, split == 0
            place.append(rel)
            rel += len(n) + (0 if at_start else magic)
            at_start = False
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("split"), pa.array(place, pa.int64()), b.column("piece")],
                                         names=["file", "split", "rel", "piece"])


def round_trip(pages: DataFrame, min_bytes: int = 0, compression: str = "none") -> DataFrame:
    """Write ``pages`` as WARC below ``spark.checkpoint.dir`` and read the archives back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes, compression)
    return read_warc(pages.sparkSession, path)
