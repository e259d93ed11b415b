"""Best-two-fit packing of tokenized documents into sequences of at most ``length`` tokens.

A bin is filled greedily, always with the longest piece that fits.  Then its smallest piece may be
replaced by two unpacked pieces that fill the gap it leaves more tightly (the best such pair),
as long as that improves the bin.

Only documents longer than a sequence are cut, into full pieces; the first may be shorter.  Pieces are
dealt to groups of about ``group`` by a hash of their content, and each group is packed by itself: the
groups are independent and equal in size however skewed ids, lengths or copies are, and each costs
at most one sequence that is not full.  Only (id, lengths, checksum) move.

Runs of white space of ``_LONG_RUN`` characters or more, which the splitting pattern could only match by backtracking once per
character, are cut out first, exactly where the pattern must split: before the run, and before its last character if
other text follows (that character may belong to the next word).  Each is one piece for the merges, so ids stay the same.

Defined results: a null text is empty and gives one piece, the end id alone; repeated rows are packed
separately; empty tables give no rows; extra columns play no part; reruns agree.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.llm.common import shuffle_partitions, stored, whole_groups

_ENCODERS: dict = {}
_LONG_RUN = 10_000
# fixed values: Unicode's white space, as the pattern's \s has it
_BLANKS = re.compile("[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG_RUN)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_of() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, whole: bool = False):
    """A fast encoder with the vocabulary of the byte-level BPE file ``path`` (ids in merge order).  With
    ``allowed_special="all"`` its ids equal those of ``tokenizers`` with add_special_tokens=False; ``encode_ordinary``
    spells added tokens out, as ``tokenizers`` does when its ``encode_special_tokens`` is set (see tests).
    ``whole``: without the splitting pattern, a text is one piece."""
    if (path, whole) not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        model = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        if any(t[k] for t in model.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        pattern = r"[\s\S]+" if whole else public_tokenizers.PATTERN
        _ENCODERS[path, whole] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path, whole]


def token_ids(path: str, text: str, encode_special_tokens: bool = False) -> np.ndarray:
    """The ids of ``tokenizers`` with add_special_tokens=False and the given ``encode_special_tokens``."""
    enc = encoder(path)
    names = () if encode_special_tokens else tuple(enc.special_tokens_set)
    ids = lambda t: enc.encode_to_numpy(t, allowed_special=set(names), disallowed_special=())
    parts, at = [], 0
    for run in _BLANKS.finditer(text):
        alone = run.end() == len(text) or text.startswith(names, run.end())  # an added token ends the text before it
        end = run.end() if alone else run.end() - 1
        parts += [ids(text[at:run.start()]), encoder(path, True).encode_to_numpy(text[run.start():end], disallowed_special=())]
        at = end
    return np.concatenate([*parts, ids(text[at:])]) if parts else ids(text)


def _cut(path: str, length: int, end: int, keep_ids: bool, encode_special_tokens: bool):
    def run(batches):
        for b in batches:
            ids_of, rows = b.column("doc_id").to_pylist(), {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(ids_of, b.column("text")):
                ids = np.append(token_ids(path, text.as_py() or "", encode_special_tokens), end).astype("<u4")
                n = len(ids)
                at = n - length * (math.ceil(n / length) - 1)
                edges = [0, *range(at, n + 1, length)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    raw = ids[lo:hi].tobytes()
                    for name, v in zip(rows, (doc, k, lo, hi - lo, zlib.crc32(raw), raw if keep_ids else None)):
                        rows[name].append(v)
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], types[n]) for n in types], names=list(types))
    return run


def best_two_fit(lengths, capacity: int) -> list[list[int]]:
    """Bins of row numbers, for rows of the given lengths (all <= capacity), in a fixed order."""
    stock: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stock.setdefault(int(lengths[i]), []).append(i)
    left = sorted(stock)  # lengths that still have rows

    def take(n):
        row = stock[n].pop()
        if not stock[n]:
            del stock[n], left[bisect_right(left, n) - 1]
        return row

    bins = []
    while left:
        room, held = capacity, []
        while room and left and (k := bisect_right(left, room)):
            n = left[k - 1]
            held.append((n, take(n)))
            room -= n
        while room and left and held:
            least, row = held[-1]  # pieces went in longest first, and replacements are sorted in
            space, best = room + least, None
            i, j = 0, bisect_right(left, space) - 1
            while i <= j:  # the pair with the largest sum within the space
                total = left[i] + left[j]
                if total > space:
                    j -= 1
                    continue
                if (i < j or len(stock[left[i]]) > 1) and (best is None or total > best[0]):
                    best = (total, left[i], left[j])
                    if total == space:
                        break
                i += 1
            if best is None or best[0] <= least:
                break
            held.pop()
            stock.setdefault(least, []).append(row)
            if len(stock[least]) == 1:
                left.insert(bisect_right(left, least), least)
            held += [(n, take(n)) for n in best[1:]]
            held.sort(key=lambda x: -x[0])
            room = space - best[0]
        bins.append([row for _, row in held])
    return bins


def _pack(capacity: int):
    def run(batches):
        for t in whole_groups(batches, ["bin_group"]):
            group, n = t.column("bin_group").to_numpy(), t.column("length").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(n))):
                for k, rows in enumerate(best_two_fit(n[lo:hi], capacity)):
                    place = 0
                    for r in rows:
                        seq[lo + r], off[lo + r] = (int(group[lo]) << 32) | k, place
                        place += int(n[lo + r])
            t = t.drop_columns(["bin_group"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield from t.to_batches()
    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 0, group: int = 8192, keep_ids: bool = False,
         encode_special_tokens: bool = True) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ``ids``, little-endian unsigned 32-bit, with ``keep_ids``).  ``encode_special_tokens`` is the flag of
    ``tokenizers`` (False there): an added token's name in a text is spelt out instead of being that token."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, length, end, keep_ids, encode_special_tokens), _PIECES + ", ids binary")
    pieces = stored(pieces if keep_ids else pieces.drop("ids"), "pieces")
    groups = max(1, math.ceil(pieces.count() / group))
    names = list(pieces.columns)
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(groups)))
    dealt = dealt.repartition(max(shuffle_partitions(docs.sparkSession), 1), "bin_group").sortWithinPartitions(
        "bin_group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    schema = _PIECES + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    return dealt.select(*names, "bin_group").mapInArrow(_pack(length), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of ``pack(..., keep_ids=True)``: sequence_id, ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["ids"]), "")).alias("ids"))
