"""Suffix-array dedup: every repeated passage of at least ``min_len`` bytes, as maximal
repeat groups with all their occurrences, from the common-prefix interval trees of
enhanced suffix arrays.

One suffix array over a corpus cannot be built in one task, so the corpus is first cut
into buckets that no repeat can straddle:

1. *Anchors.*  Every ``min_len``-byte window chooses the 32-byte string with the least
   hash in it (ties: the rightmost).  Equal windows choose the same string at the same
   place, so all copies of a window meet in the bucket of that string.  Consecutive
   windows with one anchor form a *context* (at most ``2 * min_len - 32`` bytes).
2. *Equal contexts.*  Copies of a whole context need no text: tasks keep the earliest of
   each (pre-aggregation before the shuffle) and one sorted pass keeps the earliest of
   all.  The inside of long copies ends here.
3. *Interval trees.*  Buckets with several different contexts (the ends of copies) get
   the contexts' bytes.  The suffix array at the anchor is sorted once; the array one
   byte further left is induced from it by a stable sort on that byte, and its LCP
   array by range minima.  A stack scan of each LCP array yields the common-prefix
   intervals of depth ``min_len`` or more; an interval whose occurrences all continue
   to the left with the same byte is skipped (it is not left-maximal), the others are
   the maximal repeats, with all occurrences.
4. Buckets with more than ``bucket_cap`` different contexts (the ends of a passage that a
   large part of all documents share) are split by window: each window is then a bucket
   of its own, resolved as in 2.  Nothing is dropped.

Defined results: null text is empty; texts shorter than ``min_len`` have no repeats;
documents are ordered by id (null last), rows that share an id by the 64-bit hash of the
text, which tells them apart; rows repeated whole are one document; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.llm.common import PrefixHash, bytes_of, doc_key, mix, stored, whole_groups
from intentloom.operators.joins import MAX_BROADCAST_BYTES, table_bytes

K = 32                    # bytes of an anchor string
SEGMENT = 1 << 20         # bytes hashed at a time
FLUSH = 1 << 18           # anchors held by a task before it pre-aggregates them
BUCKET_CAP = 512          # different contexts of a bucket for one interval tree
STRIP = 1 << 22           # bytes of texts that are stripped at a time
CHUNK = 1 << 16           # contexts whose interval trees are built at a time
_ROWS = ("kind int, bucket long, ctx long, doc long, loc long, bytes binary, "
         "tag long, lo long, hi long, repeat long, first boolean")
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_CONTEXT, _SPAN, _ASK, _ASK_WINDOWS = range(4)
_SPAN_COLUMNS = ["doc", "tag", "lo", "hi", "repeat", "first"]

# doc and tag (the text's hash where the doc's id is shared) name a text; loc packs where a context lies in it:
# pos of the anchor | windows before it (7 + 7) | copy flag


def _pack(pos, before, after, dup=0):
    return ((((pos << 7) | before) << 7 | after) << 1) | dup


def _unpack(loc):
    return loc >> 15, (loc >> 8) & 127, (loc >> 1) & 127


def _contexts(data: np.ndarray, off: np.ndarray, min_len: int):
    """Contexts of the texts ``data[off[i]:off[i+1]]`` (one segment): document index,
    anchor, first and last window start, anchor hash, context hash."""
    n, w = len(data), min_len - K + 1
    if n < min_len:
        return None
    h = PrefixHash(data)
    grams = h.every(K)
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (mix(grams) & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    step = 1
    while step < w:  # sliding minimum by doubling
        jump = min(step, w - step)
        least = np.minimum(least[:-jump], least[jump:])
        step += jump
    anchor = (low - (least & low)).astype(np.int64)
    bad = np.zeros(n + 1, np.int32)
    np.add.at(bad, np.maximum(off[:-1], off[1:] - (min_len - 1)), 1)
    np.add.at(bad, off[1:], -1)
    ok = np.cumsum(bad)[:len(anchor)] == 0
    new = ok.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    last = ok.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~ok[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    if not len(first):
        return None
    a = anchor[first]
    ctx = h.range_hash(first, last + min_len)
    ctx = mix(ctx ^ ((a - first) * 128 + (a - last)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = np.searchsorted(off, first, "right") - 1
    return doc, a - off[doc], first - off[doc], last - off[doc], grams[a], ctx


def _segments(off: np.ndarray, min_len: int):
    """Cuts ``(first text, last text, byte from, byte to)``: whole texts up to SEGMENT bytes;
    a longer text in overlapping parts (its windows are cut, none is lost)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + SEGMENT, "right")) - 1
        if j > i:
            yield i, j, off[i], off[j]
            i = j
        else:
            lo = off[i]
            while True:
                hi = min(off[i + 1], lo + SEGMENT)
                yield i, i + 1, lo, hi
                if hi == off[i + 1]:
                    break
                lo = hi - (min_len - 1)
            i += 1


def _rows(kind, doc, bucket=None, ctx=None, loc=None, text=None, tag=None, lo=None, hi=None, repeat=None, first=None):
    """One record batch of ``_ROWS``; what a kind of row does not have is null."""
    n = len(doc)
    long = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), long(bucket), long(ctx), long(doc), long(loc),
         pa.nulls(n, pa.binary()) if text is None else text,
         long(tag), long(lo), long(hi), long(repeat),
         pa.nulls(n, pa.bool_()) if first is None else pa.array(np.broadcast_to(first, (n,)))], names=_NAMES)


def _elsewhere(rows, head):
    """Whether rows lie at another place than those of ``head``, given (bucket, ctx, doc, tag, loc)."""
    _, _, doc, tag, loc = rows
    return (doc != doc[head]) | (tag != tag[head]) | (loc >> 15 != loc[head] >> 15)


def _spans_of(bucket, ctx, doc, tag, loc, first, min_len):
    pos, before, after = _unpack(loc)
    return _rows(_SPAN, doc, tag=tag, lo=pos - before, hi=pos - after + min_len, first=first,
                 repeat=mix(bucket.view(np.uint64) ^ mix(ctx.view(np.uint64))))


def _flush(held, min_len):
    """Pre-aggregate a task's contexts: the earliest of equal ones goes on, the copies are spans.
    A row at the very same place as the earliest is the same occurrence, not a copy."""
    if not held:
        return
    bucket, ctx, doc, tag, loc = (np.concatenate(x) for x in zip(*held))
    bucket, ctx = bucket.view(np.int64), ctx.view(np.int64)
    held.clear()
    o = np.lexsort((loc, tag, doc, ctx, bucket))
    bucket, ctx, doc, tag, loc = rows = bucket[o], ctx[o], doc[o], tag[o], loc[o]
    lead = np.ones(len(o), bool)
    lead[1:] = (bucket[1:] != bucket[:-1]) | (ctx[1:] != ctx[:-1])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(o)), 0))
    copy = ~lead & _elsewhere(rows, head)
    loc[head[copy]] |= 1
    yield _rows(_CONTEXT, doc[lead], bucket[lead], ctx[lead], loc[lead], tag=tag[lead])
    if copy.any():
        yield _spans_of(*(x[copy] for x in rows), False, min_len)


def _find_contexts(min_len):
    """Texts -> their contexts, pre-aggregated per task, and the spans found on the way."""
    def run(batches):
        held, count = [], 0
        for b in batches:
            data, off = bytes_of(b.column("text"))
            ids, tags = b.column("doc").to_numpy(), b.column("tag").to_numpy()
            for i, j, lo, hi in _segments(off, min_len):
                got = _contexts(data[lo:hi], np.clip(off[i:j + 1], lo, hi) - lo, min_len)
                if got is None:
                    continue
                d, a, first, last, gram, ctx = got
                shift = lo - off[i]  # a part of a long text
                held.append((gram, ctx, ids[i + d], tags[i + d], _pack(a + shift, a - first, a - last)))
                count += len(d)
                if count >= FLUSH:
                    yield from _flush(held, min_len)
                    count = 0
        yield from _flush(held, min_len)
    return run


def _meet(batches, min_len, cap):
    """Contexts sorted by (bucket, ctx, doc, tag, loc), each bucket whole in one partition: later
    copies of a context become spans; the different contexts of a bucket ask for their text.
    Holds at most ``cap`` contexts of one bucket."""
    last, said = None, True          # the context in hand: its earliest row, and whether that is a span yet
    carry = np.zeros((0, 5), np.int64)  # different contexts of the bucket in hand
    hot = None                       # the bucket in hand, if it has more than ``cap``
    for b in batches:
        held = [b.column(x).to_numpy() for x in ("bucket", "ctx", "doc", "tag", "loc")]
        if last is not None:  # the context in hand goes before the batch
            held = [np.insert(x, 0, v) for x, v in zip(held, last)]
        bucket, ctx, doc, tag, loc = held
        lead = np.ones(len(bucket), bool)
        lead[1:] = (bucket[1:] != bucket[:-1]) | (ctx[1:] != ctx[:-1])
        head = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
        copy = ~lead & _elsewhere(held, head)
        if copy.any():
            yield _spans_of(*(x[copy] for x in held), False, min_len)
        stays = lead & ((loc & 1) == 1)
        stays[head[copy]] = True
        told = bool(stays[0]) if last is not None else False
        if last is not None and said:
            stays[0] = False
        if stays.any():
            yield _spans_of(*(x[stays] for x in held), True, min_len)
        at = np.flatnonzero(lead)
        end = at[-1]
        said = (told or said) if (last is not None and end == 0) else bool(stays[end])
        fresh = at[1:] if last is not None else at
        last = [x[end] for x in held]
        rows = np.stack([x[fresh] for x in held], 1)
        if hot is not None:
            more = int(np.searchsorted(rows[:, 0] != hot, True))
            if more:
                yield _asked(_ASK_WINDOWS, rows[:more])
            if more == len(rows):
                continue
            rows, hot = rows[more:], None
        rows = np.concatenate([carry, rows])
        if not len(rows):
            continue
        starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        size = np.diff(np.append(starts, len(rows)))
        open_at = starts[-1]
        each = np.repeat(size, size)[:open_at]
        if ((each > 1) & (each <= cap)).any():
            yield _asked(_ASK, rows[:open_at][(each > 1) & (each <= cap)])
        if (each > cap).any():
            yield _asked(_ASK_WINDOWS, rows[:open_at][each > cap])
        carry = rows[open_at:]
        if len(carry) > cap:
            yield _asked(_ASK_WINDOWS, carry)
            hot, carry = carry[0, 0], carry[:0]
    if len(carry) > 1:
        yield _asked(_ASK, carry)


def _asked(kind, rows):
    bucket, ctx, doc, tag, loc = rows.T
    return _rows(kind, doc, bucket, ctx, loc, tag=tag)


def _fetch(min_len):
    """Texts joined with what is asked of them -> contexts with their bytes; for hot buckets,
    one context per window (a bucket of its own), which needs no bytes."""
    def run(batches):
        held, count = [], 0
        for b in batches:
            data, off = bytes_of(b.column("text"))
            ids, tags = b.column("doc").to_numpy(), b.column("tag").to_numpy()
            asks = b.column("asks")
            at = np.asarray(asks.offsets, np.int64)
            owner = np.repeat(np.arange(len(ids)), np.diff(at))
            bucket, loc, windows = (asks.values.field(x).to_numpy(zero_copy_only=False)[at[0]:at[-1]] for x in range(3))
            pos, before, after = _unpack(loc)
            cold = np.flatnonzero(~windows)
            for part in np.array_split(cold, len(cold) // CHUNK + 1):
                if not len(part):
                    continue
                lo = off[owner[part]] + pos[part] - before[part]
                size = before[part] - after[part] + min_len
                ends = np.cumsum(size)
                idx = np.repeat(lo - (ends - size), size) + np.arange(ends[-1])
                blob = pa.Array.from_buffers(pa.binary(), len(part), [
                    None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[idx])])
                yield _rows(_ASK, ids[owner[part]], bucket[part], loc=loc[part], text=blob, tag=tags[owner[part]])
            hot = np.flatnonzero(windows)
            for i in np.unique(owner[hot]):
                mine = hot[owner[hot] == i]
                for lo, hi in zip(pos[mine] - before[mine], pos[mine] - after[mine]):
                    h = PrefixHash(data[off[i] + lo:off[i] + hi + min_len])
                    s = np.arange(hi - lo + 1)
                    held.append((mix(h.range_hash(s, s + min_len)), mix(h.range_hash(s + min_len // 3, s + min_len)),
                                 np.full(len(s), ids[i]), np.full(len(s), tags[i]), _pack(s + lo, 0 * s, 0 * s)))
                    count += len(s)
                if count >= FLUSH:
                    yield from _flush(held, min_len)
                    count = 0
        yield from _flush(held, min_len)
    return run


def _intervals(lcp, diff, lo, hi, floor):
    """Stack scan of ``lcp[lo+1..hi]`` (entry i: common prefix of suffixes i-1 and i): the
    common-prefix intervals of depth >= floor whose occurrences differ to the left."""
    stack, out = [], []
    for i in range(lo + 1, hi + 2):
        depth = lcp[i] if i <= hi else 0
        left = i - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            if diff[i - 1] > diff[left]:
                out.append((d, left, i - 1))
        if depth >= floor and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return out


def repeats_in_buckets(bucket, doc, tag, loc, text, min_len):
    """Maximal repeats of bucketed contexts: arrays (repeat, member row, start, depth, first)."""
    n = len(bucket)
    width = min_len - K  # most bytes before an anchor
    pos, before, after = _unpack(loc)
    data, off = bytes_of(text)
    size = off[1:] - off[:-1]
    x = np.zeros((n, width + min_len), np.uint8)
    col = np.arange(len(data)) - np.repeat(off[:-1], size) + np.repeat(width - before, size)
    x[np.repeat(np.arange(n), size), col] = data
    right = min_len - after  # bytes from the anchor on
    group = np.unique(bucket, return_inverse=True)[1]
    pad = np.zeros((n, -min_len % 8 + min_len), np.uint8)
    pad[:, :min_len] = x[:, width:]
    words = pad.view(">u8")
    order = np.lexsort((right, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group))
    same = x[order[1:], width:] != x[order[:-1], width:]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(same.any(1), same.argmax(1), min_len)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(right[order[1:]], right[order[:-1]]))
    lcp[1:][group[order[1:]] != group[order[:-1]]] = 0
    out = []
    for o in range(width + 1):
        deep = lcp >= min_len
        reach = before[order] > o
        byte = np.where(reach, x[order, width - o - 1] if o < width else 0, 256).astype(np.int64)
        if deep.any():
            step = np.zeros(len(order), np.int64)
            step[1:] = (byte[1:] != byte[:-1]) | ~reach[1:]
            diff = np.cumsum(step)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], deep.view(np.int8), [0]))))
            for lo, hi in zip((edge[0::2] - 1).tolist(), (edge[1::2] - 1).tolist()):
                if diff[hi] > diff[lo]:
                    for d, i, j in _intervals(lcp, diff, lo, hi, min_len):
                        out.append((o, int(d), order[i:j + 1]))
        if o == width:
            break
        keep = np.flatnonzero(reach)
        if not len(keep):
            break
        nxt = keep[np.argsort(group[order[keep]] * 256 + byte[keep], kind="stable")]
        g, by = group[order[nxt]], byte[nxt]
        grown = np.zeros(len(nxt), np.int64)
        pair = np.flatnonzero((g[1:] == g[:-1]) & (by[1:] == by[:-1])) + 1
        if len(pair):
            ends = np.stack([nxt[pair - 1] + 1, nxt[pair] + 1], 1).ravel()
            grown[pair] = np.minimum.reduceat(np.append(lcp, 0), ends)[::2] + 1
        order, lcp = order[nxt], grown
    if not out:
        return None
    member = np.concatenate([m for _, _, m in out])
    count = np.array([len(m) for _, _, m in out])
    o = np.repeat([a for a, _, _ in out], count)
    depth = np.repeat([d for _, d, _ in out], count)
    which = np.repeat(np.arange(len(out)), count)
    s = np.lexsort((pos[member], tag[member], doc[member], which))
    member, o, depth, which = member[s], o[s], depth[s], which[s]
    head = np.ones(len(which), bool)
    head[1:] = which[1:] != which[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    here = (doc[member] == doc[member[lead]]) & (tag[member] == tag[member[lead]]) & (pos[member] == pos[member[lead]])
    repeat = mix(bucket[member].view(np.uint64) ^ mix(doc[member[lead]].view(np.uint64) ^ mix(tag[member[lead]].view(np.uint64) ^ mix(
        ((pos[member[lead]] * 256 + o) * 256 + depth).view(np.uint64)))))
    return member, pos[member] - o, depth, repeat, here


def _trees(batches, min_len):
    """Contexts with bytes, sorted by bucket -> spans of the maximal repeats."""
    def spans(t):
        bucket, doc, tag, loc = (t.column(c).to_numpy() for c in ("bucket", "doc", "tag", "loc"))
        got = repeats_in_buckets(bucket, doc, tag, loc, t.column("bytes"), min_len)
        if got is not None:
            member, start, depth, repeat, first = got
            yield _rows(_SPAN, doc[member], tag=tag[member], lo=start, hi=start + depth, repeat=repeat, first=first)

    for t in whole_groups(batches, ["bucket"], CHUNK):
        yield from spans(t)


def _by_bucket(rows: DataFrame) -> DataFrame:
    by = F.coalesce(F.col("bucket"), F.xxhash64("doc", "lo"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, by).sortWithinPartitions("kind", "bucket", "ctx", "doc", "tag", "loc")


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Texts with their ``doc`` and ``tag``: the text's hash where other rows share the id, else 0 (which costs nothing to send).
    If the ids that are shared are too many to broadcast, all rows have the hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(doc_key().alias("doc"), text.alias("text"), F.struct(*carry).alias("carry"))
    shared = stored(rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc", F.lit(True).alias("shared")), "shared-ids")
    if table_bytes(shared) > MAX_BROADCAST_BYTES:
        return rows.select("doc", F.xxhash64("text").alias("tag"), "text", "carry")
    tag = F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(F.broadcast(shared), "doc", "left").select("doc", tag.alias("tag"), "text", "carry")


def repeated_spans(docs: DataFrame, min_len: int = 100, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """All occurrences of the maximal repeats of ``docs(doc_id, text)``: ``doc, tag, lo, hi, repeat, first``.

    ``[lo, hi)`` are byte places in the UTF-8 text, ``repeat`` names the group, ``first`` marks its
    earliest occurrence; ``tag`` (the text's hash, 0 for an id of its own) tells rows that share a doc_id apart.  Groups are maximal within
    an anchor's context, so a longer repeat is a chain of overlapping groups; in a bucket with more
    than ``bucket_cap`` contexts the groups are its windows.  Each group lists every occurrence:

    * Trees and windows see the earliest of equal contexts only; its members are repeated here for
      each copy of that context, moved by as much as the copy lies elsewhere.
    * A context that lies whole in another one is a tree's group too, with more members, and not
      listed a second time; nor is one of a hot bucket whose windows are all listed.
    """
    events, late = _events(_keyed(docs, ["doc_id"]), min_len, bucket_cap)
    place, blocks = ["doc", "tag"], lambda lo, hi: F.explode(F.sequence(F.shiftright(lo, 7), F.shiftright(hi, 7)))
    late = stored(late.filter(F.col("kind") == _SPAN).select(*_SPAN_COLUMNS), "suffix-members")
    # a row that is there twice is one occurrence; copies by context, and the earliest of each
    whole = stored(events.filter(F.col("kind") == _SPAN).select(*_SPAN_COLUMNS).distinct(), "suffix-wholes")
    before, after = (F.shiftright("loc", n).bitwiseAND(F.lit(127)) for n in (8, 1))
    pos = F.shiftright("loc", 15)
    hot = events.filter(F.col("kind") == _ASK_WINDOWS).select(
        "doc", "tag", (pos - before).alias("lo"), (pos - after + min_len).alias("hi"), F.lit(True).alias("hot"))
    lead = (whole.filter("first").join(hot, [*place, "lo", "hi"], "left")
            .select(*place, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("repeat").alias("_whole"), F.col("hot").isNotNull().alias("hot"))
            .withColumn("_at", blocks(F.col("_lo"), F.col("_hi") - min_len)))
    # a window lies in one context, so a member finds the one it was taken from
    members = stored(late.withColumn("_at", F.shiftright("lo", 7)).join(lead, [*place, "_at"])
                     .filter((F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi")))
                     .select("_whole", "hot", "repeat", F.col("_hi").alias("end"), F.col("_lo").alias("begin"),
                             (F.col("lo") - F.col("_lo")).alias("_skip"), (F.col("hi") - F.col("lo")).alias("_size")), "suffix-moves")
    width = F.col("end") - F.col("begin")
    twice = members.groupBy("_whole").agg(
        F.max(F.col("_size") == width).alias("tree"), F.max("hot").alias("hot"), F.count_distinct("_skip").alias("n"), F.max(width - min_len + 1).alias("windows"))
    twice = twice.filter(F.col("tree") | (F.col("hot") & (F.col("n") == F.col("windows")))).select(F.col("_whole").alias("repeat"))
    moved = (members.select("_whole", "repeat", "_skip", "_size")
             .join(whole.filter(~F.col("first")).select("doc", "tag", "lo", F.col("repeat").alias("_whole")), "_whole")
             .select("doc", "tag", (F.col("lo") + F.col("_skip")).alias("lo"), (F.col("lo") + F.col("_skip") + F.col("_size")).alias("hi"),
                     "repeat", F.lit(False).alias("first")))
    return whole.join(twice, "repeat", "left_anti").select(*_SPAN_COLUMNS).unionByName(late).unionByName(moved)


def _spans(texts: DataFrame, min_len: int, bucket_cap: int) -> DataFrame:
    """Spans that cover all repeated bytes: those found with the contexts, and of trees and windows."""
    events, late = _events(texts, min_len, bucket_cap)
    return events.filter(F.col("kind") == _SPAN).select(*_SPAN_COLUMNS).unionByName(
        late.filter(F.col("kind") == _SPAN).select(*_SPAN_COLUMNS))


def _events(texts: DataFrame, min_len: int, bucket_cap: int) -> tuple[DataFrame, DataFrame]:
    """What comes of the contexts (written), and of the trees and windows of their buckets."""
    if min_len < K + 8 or min_len - K > 127:
        raise ValueError("min_len must lie between 40 and 159")
    events = stored(_by_bucket(texts.select("doc", "tag", "text").mapInArrow(_find_contexts(min_len), _ROWS)).mapInArrow(
        _split_spans(lambda b: _meet(b, min_len, bucket_cap)), _ROWS).drop("bytes"), "suffix-events")
    asks = (events.filter(F.col("kind") >= _ASK)
            .select("doc", "tag", F.struct("bucket", "loc", (F.col("kind") == _ASK_WINDOWS).alias("windows")).alias("ask"))
            .groupBy("doc", "tag").agg(F.collect_list("ask").alias("asks")))
    # all columns of the texts go along, so that this shuffle of texts also serves the final join
    fetched = texts.join(asks, ["doc", "tag"]).mapInArrow(_fetch(min_len), _ROWS)

    def trees_and_windows(batches):
        # kinds come sorted: first the windows of hot buckets, then the contexts with bytes
        kinds = {_CONTEXT: lambda b: _meet(b, min_len, 1 << 62), _ASK: lambda b: _trees(b, min_len)}
        head = []

        def of(kind):
            while True:
                b = head.pop() if head else next(batches, None)
                if b is None:
                    return
                k = b.column("kind").to_numpy()
                if (k == kind).any():
                    yield b.filter(pa.array(k == kind))
                if (k > kind).any():
                    head.append(b.filter(pa.array(k > kind)))
                    return

        for kind, work in kinds.items():
            yield from work(of(kind))

    return events, _by_bucket(fetched).mapInArrow(_split_spans(trees_and_windows), _ROWS)


def _split_spans(work):
    """Spans pass by, all other rows go through ``work``."""
    def run(batches):
        aside = []

        def rest():
            for b in batches:
                k = b.column("kind").to_numpy()
                if (k == _SPAN).any():
                    aside.append(b.filter(pa.array(k == _SPAN)))
                if (k != _SPAN).any():
                    yield b.filter(pa.array(k != _SPAN))

        for out in work(rest()):
            yield out
            while aside:
                yield aside.pop()
        while aside:
            yield aside.pop()
    return run


def _strip(as_text):
    """Texts with their spans -> what is left."""
    def run(batches):
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < b.num_rows:  # some rows at a time, or one longer text: marks take many times a text's bytes
                done = size[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(size, done + STRIP, "right")))
                yield _stripped(b.slice(i, j - i), as_text)
                i = j
    return run


def _stripped(b, as_text):
    data, off = bytes_of(b.column("text"))
    spans = b.column("spans")
    at = np.asarray(spans.offsets, np.int64)
    lo, hi = (spans.values.field(x).to_numpy(zero_copy_only=False)[at[0]:at[-1]] for x in range(2))
    owner = np.repeat(np.arange(b.num_rows), np.diff(at))
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, off[owner] + lo, 1)
    np.add.at(mark, off[owner] + hi, -1)
    gone = np.cumsum(mark)[:-1] > 0
    total = np.concatenate(([0], np.cumsum(gone)))
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    begin[edges] = gone[edges]  # runs do not cross texts
    runs = np.concatenate(([0], np.cumsum(begin)))
    kept, sha = [], []
    for i in range(b.num_rows):
        left = data[off[i]:off[i + 1]]
        left = left.tobytes() if total[off[i]] == total[off[i + 1]] else left[~gone[off[i]:off[i + 1]]].tobytes()
        kept.append(left.decode("utf-8", "ignore") if as_text else left)
        sha.append(hashlib.sha256(left).hexdigest())
    return pa.RecordBatch.from_arrays(
        [b.column("carry"), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]),
         pa.array(runs[off[1:]] - runs[off[:-1]]), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(sha, pa.string())],
        names=["carry", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def suffix_dedup(docs: DataFrame, min_len: int = 100, bucket_cap: int = BUCKET_CAP, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Remove each byte covered by a ``min_len``-byte string that also starts earlier.

    Returns per row of ``docs``: the columns ``carry`` (by default doc_id), n_bytes, n_removed, n_spans (maximal
    removed runs), kept (the bytes left; ``as_text``: as a string, without characters that were cut in two) and
    kept_sha256 (of the bytes).
    """
    carry = carry or ["doc_id"]
    texts = _keyed(docs, carry)
    spans = (_spans(texts, min_len, bucket_cap).filter(~F.col("first"))
             .groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    joined = texts.join(spans, ["doc", "tag"], "left").select(
        "carry", "text", F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<lo:bigint,hi:bigint>>")).alias("spans"))
    schema = joined.select("carry").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "string" if as_text else "binary"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    out = joined.mapInArrow(_strip(as_text), schema)
    return out.select(*(F.col("carry")[c].alias(c) for c in carry), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
