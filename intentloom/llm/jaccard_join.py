"""N-gram Jaccard join by chosen paths: recursive splits on sampled shared tokens, exact verification.

Sets are word shingles (five words).  Equal sets are joined once.  A set is embedded as ``COORDS``
sampled tokens: for each of as many hash functions, its token of least hash.  Two sets of
similarity J share each sampled token with probability J.

* A *run* splits all sets by one sampled token.  A bucket that is still too large is split again by each of
  ``CHILDREN`` further tokens, chosen by a hash of the path; a pair at the threshold stays together in one of them
  at least with probability 1 - (1 - J)^CHILDREN.
* Buckets of at most ``limit`` sets are compared by brute force.  So are, block against block, buckets whose sets are alike
  indeed (a further token keeps ``_TIGHT`` of their pairs together: splits would copy them and lose links, and gain
  nothing), and buckets that ``depth`` further splits leave large.
* Runs repeat until the target recall: ``runs_for`` gives the least number that misses a pair at the threshold, on
  its longest path of splits, with a probability of ``1 - recall`` at most (12 for 0.8, two splits and 2e-8).

A pair is counted in the first bucket that it shares, so nothing is emitted per pair: buckets
return each set's number of links and a spanning forest.  Candidates are first screened by
their embeddings (a link falls below the screen with probability < 1e-9); only buckets that
keep some get tokens, computed from the texts that they need.  Similarities are exact.

Classes are the connected components of the links, by alternating large-star and small-star steps.

Defined results: words are runs of non-space characters; a text of fewer than five words has one
shingle, all its words; texts without words (null, empty) link to nothing and are classes of their own;
repeated rows are linked copies; class ids are the least doc_id (null only if all are null); empty
tables give no rows; extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentloom.llm.common import MAX_LONG, PrefixHash, bytes_of, doc_key, mix, shuffle_partitions, stored, whole_groups
from intentloom.operators.joins import checked_broadcast

COORDS = 64
CHILDREN = 3
_TIGHT = 0.6     # share of a bucket's pairs that a further token keeps together, from which it is compared as it is
_BLOCK_TOKENS = 1 << 21  # shingles of a block of a large bucket, besides its bound in sets
_HOT = 1024      # sets of a bucket whose size is sent to all tasks instead of its rows to one
_PART = 1 << 20  # bytes hashed at a time
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDS, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data, starts, ends):
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):  # runs of words that span at most _PART bytes (or one longer word)
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PART, "right")))
        h = PrefixHash(data[starts[i]:ends[j - 1]])
        out[i:j] = h.range_hash(starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts ``data[off[i]:off[i+1]]``, ascending per text, and their offsets."""
    n = len(off) - 1
    word = ~_SPACE[data]
    lead, tail = word.copy(), word.copy()
    lead[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    lead[inner] = word[inner]  # words do not cross texts
    tail[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(lead), np.flatnonzero(tail) + 1
    h = _word_hashes(data, starts, ends)
    doc = np.searchsorted(off, starts, "right") - 1
    many = len(h) - width + 1
    tok, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if many > 0:
        t = h[:many].copy()
        for j in range(1, width):
            t = mix(t) + h[j:many + j]
        inside = doc[:many] == doc[width - 1:]
        tok, own = mix(t[inside]), doc[:many][inside]
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(doc, short)
        t = h[first].copy()
        for j in range(1, width):
            more = count[short] > j
            t[more] = mix(t[more]) + h[first[more] + j]
        tok, own = np.concatenate([tok, mix(t ^ count[short].astype(np.uint64))]), np.concatenate([own, short])
    o = np.lexsort((tok, own))
    tok, own = tok[o], own[o]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
    return tok[new], np.concatenate(([0], np.cumsum(np.bincount(own[new], minlength=n))))


def _parts(off) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _PART, "right")) - 1)
        yield i, j
        i = j


def _embed(width):
    """Texts -> number of shingles, set id (64 bits of the whole set), embedding."""
    def run(batches):
        for b in batches:
            data, off = bytes_of(b.column("text"))
            for i, j in _parts(off):
                tok, at = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], width)
                size = np.diff(at)
                full = np.flatnonzero(size)
                sid = np.zeros(j - i, np.uint64)
                low = np.zeros((j - i, COORDS), np.uint32)
                if len(full):
                    first = at[:-1][full]
                    sid[full] = mix(np.add.reduceat(mix(tok), first) ^ mix(np.add.reduceat(mix(tok + np.uint64(99)), first)))
                    for c in range(COORDS):
                        low[full, c] = np.minimum.reduceat((tok * _A[c] + _B[c]) >> np.uint64(32), first)
                part = b.slice(i, j - i)
                blob = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((np.arange(j - i + 1) * 4 * COORDS).astype(np.int32)), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("doc"), part.column("th"), pa.array(size.astype(np.int32)),
                                                  pa.array(sid.view(np.int64)), blob], names=["doc_id", "doc", "th", "n", "sid", "embed"])
    return run


def _coords(col) -> np.ndarray:
    data, _ = bytes_of(col)
    return np.frombuffer(data.tobytes(), np.uint32).reshape(len(col), COORDS)


def _first_split(runs):
    def run(batches):
        for b in batches:
            low = _coords(b.column("embed")).astype(np.uint64)
            for r in range(runs):
                node = mix(low[:, r] ^ np.uint64((r + 1) << 40))
                yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("size"), pa.array(np.full(len(low), r, np.int32)), pa.array(node.view(np.int64))],
                                                 names=["sid", "size", "run", "node"])
    return run


def _next_split(runs, children):
    """Sets of large buckets -> their place in each of ``children`` splits of the bucket."""
    def run(batches):
        for b in batches:
            low, sid, size, r = _coords(b.column("embed")), b.column("sid"), b.column("size"), b.column("run")
            parent = b.column("node").to_numpy()
            seed = mix(parent.view(np.uint64) + np.uint64(1))
            for child in children:  # different tokens: 17 and 34 steps apart among 52
                c = (runs + (seed + np.uint64(17 * child)) % np.uint64(COORDS - runs)).astype(np.int64)
                new = mix(mix(seed + np.uint64(child)) ^ low[np.arange(len(c)), c].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([sid, size, r, pa.array(new.view(np.int64)), pa.array(parent)], names=["sid", "size", "run", "node", "parent"])
    return run


def runs_for(threshold: float, recall: float, depth: int) -> int:
    """Runs that miss a pair at the threshold with a probability of at most ``1 - recall``, after ``depth`` splits."""
    together = threshold * (1 - (1 - threshold) ** CHILDREN) ** depth
    return min(COORDS // 2, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _sized(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` of buckets of two sets or more, with their sizes ``n`` and ``tokens``.  The few large buckets' sizes go to the rows."""
    large = checked_broadcast(sizes.filter(F.col("n") > _HOT))
    small = sizes.filter(F.col("n").between(2, _HOT))
    return rows.join(large, "node").unionByName(rows.join(large, "node", "left_anti").join(small, "node"))


def _leaves(sets: DataFrame, runs: int, limit: int, depth: int) -> DataFrame:
    """The buckets that are compared: sid, run, node, n, tokens (all have two sets or more)."""
    names = ["sid", "run", "node", "n", "tokens"]
    total = [F.count("*").alias("n"), F.sum("size").alias("tokens")]
    rows = stored(sets.select("sid", "size", "embed").mapInArrow(_first_split(runs), "sid long, size int, run int, node long"), "paths-0")
    shared = stored(_sized(rows, rows.groupBy("node").agg(*total)).select(names), "buckets-0")
    found = shared.filter(F.col("n") <= limit)
    for level in range(1, depth + 1):
        large = shared.filter(F.col("n") > limit)
        if not large.limit(1).count():
            return found
        schema = "sid long, size int, run int, node long, parent long"
        large = stored(large.join(sets.select("sid", "size", "embed"), "sid").select("sid", "size", "embed", *names[1:]), f"large-{level}")
        probe = large.mapInArrow(_next_split(runs, [0]), schema).groupBy("parent", "node").agg(F.count("*").cast("double").alias("n"))
        kept = F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))
        tight = checked_broadcast(probe.groupBy(F.col("parent").alias("node")).agg(kept.alias("kept")).filter(F.col("kept") >= _TIGHT).select("node"))
        found = found.unionByName(large.join(tight, "node", "left_semi").select(names))
        loose = large.join(tight, "node", "left_anti").select("sid", "size", "embed", "run", "node")
        rows = stored(loose.mapInArrow(_next_split(runs, range(CHILDREN)), schema).drop("parent"), f"paths-{level}")
        shared = stored(_sized(rows, rows.groupBy("node").agg(*total)).select(names), f"buckets-{level}")
        found = found.unionByName(shared.filter(F.col("n") <= limit) if level < depth else shared)
    return found


_KEY = ["node", "bi", "bj"]


def _blocked(leaves: DataFrame, block: int) -> DataFrame:
    """Buckets over ``block`` sets (or very many shingles) become pairs of blocks: adds own block ``b`` and the pair ``bi <= bj``."""
    nb = F.least(F.ceil(F.greatest(F.col("n") / block, F.col("tokens") / _BLOCK_TOKENS)), F.col("n")).cast("int")
    return (leaves.withColumn("nb", nb).withColumn("b", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
            .withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("nb", "o", "n", "tokens"))


def _groups(t: pa.Table):
    key = np.stack([t.column(k).to_numpy() for k in _KEY], 1)
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    return key, zip(starts.tolist(), np.append(starts[1:], len(key)).tolist())


def _pairs(mask, b, bi, bj):
    """(i, j) of a square mask: i < j within a block, or across two blocks."""
    if bi == bj:
        return np.nonzero(np.triu(mask, 1))
    i, j = np.nonzero(mask & ((b == bi)[:, None] & (b == bj)[None, :]))
    return i, j


def _first_shared(i, j, node, paths, sets):
    """The pairs whose first shared bucket is ``node``; paths come in the order of runs."""
    keep = [next((p for p in paths[x] if p in sets[y]), None) == node for x, y in zip(i.tolist(), j.tolist())]
    keep = np.array(keep, bool)
    return i[keep], j[keep]


def _screen(threshold):
    """Buckets with embeddings -> the sets that have a likely link to be counted there."""
    least = int(COORDS * threshold - 7 * math.sqrt(COORDS * threshold * (1 - threshold)))

    def run(batches):
        for t in whole_groups(batches, _KEY, 1 << 15):
            low, size, b = _coords(t.column("embed").combine_chunks()), t.column("size").to_numpy(), t.column("b").to_numpy()
            paths = t.column("paths").to_pylist()
            key, groups = _groups(t)
            keep = np.zeros(len(key), bool)
            for lo, hi in groups:
                if hi - lo < 2:
                    continue
                s = size[lo:hi]
                mask = np.minimum(s[:, None], s[None, :]) >= threshold * np.maximum(s[:, None], s[None, :])
                e = low[lo:hi]
                if hi - lo <= 8:
                    mask &= (e[:, None, :] == e[None, :, :]).sum(2) >= least
                else:
                    agree = np.zeros((hi - lo, hi - lo), np.uint8)
                    for c in range(COORDS):
                        agree += e[:, c][:, None] == e[:, c][None, :]
                    mask &= agree >= least
                i, j = _pairs(mask, b[lo:hi], key[lo, 1], key[lo, 2])
                if len(i):
                    p = paths[lo:hi]
                    i, j = _first_shared(i, j, key[lo, 0], p, [set(x) for x in p])
                    keep[lo + i] = keep[lo + j] = True
            yield from t.filter(pa.array(keep)).select([*_KEY, "b", "sid"]).combine_chunks().to_batches()
    return run


def _tokens(width):
    """Texts with the buckets that need them -> one row per bucket with the text's shingles."""
    def run(batches):
        for b in batches:
            data, off = bytes_of(b.column("text"))
            for i, j in _parts(off):
                tok, at = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], width)
                part = b.slice(i, j - i)
                wanted = part.column("wanted")
                counts = np.diff(np.asarray(wanted.offsets))
                flat = wanted.flatten()
                own = np.repeat(np.arange(j - i), counts)
                for cut in np.array_split(np.arange(len(own)), len(own) // 512 + 1):
                    if not len(cut):
                        continue
                    blobs = [tok[at[x]:at[x + 1]].tobytes() for x in own[cut]]
                    pick = pa.array(own[cut])
                    yield pa.RecordBatch.from_arrays(
                        [*(flat.field(c).take(pa.array(cut)) for c in range(4)), part.column("sid").take(pick), part.column("copies").take(pick),
                         part.column("paths").take(pick), pa.array(blobs, pa.large_binary() if sum(map(len, blobs)) >> 31 else pa.binary())],
                        names=[*_KEY, "b", "sid", "copies", "paths", "tokens"])
    return run


def _overlaps(tok, own, m):
    """Sizes of all pairwise intersections of ``m`` sets (rows of token and owner, distinct)."""
    _, ids, n = np.unique(tok, return_inverse=True, return_counts=True)
    use = n[ids] > 1
    col, own = np.unique(ids[use], return_inverse=True)[1], own[use]
    total = np.zeros((m, m), np.float64)
    width = max(1, (1 << 22) // m)
    o = np.argsort(col, kind="stable")
    col, own = col[o], own[o]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, z = np.searchsorted(col, lo), np.searchsorted(col, lo + width)
        x = np.zeros((m, width if z < len(col) else int(col[-1]) - lo + 1), np.float32)
        x[own[a:z], col[a:z] - lo] = 1
        total += x @ x.T
    return total.astype(np.int64)


def _verify(threshold):
    """Buckets with shingles -> per set its links counted there, and a forest edge to the least set linked."""
    def run(batches):
        for t in whole_groups(batches, _KEY, 1):
            data, off = bytes_of(t.column("tokens"))
            tok_all, at = np.frombuffer(data.tobytes(), np.uint64), off // 8
            sid, copies, b = (t.column(c).to_numpy() for c in ("sid", "copies", "b"))
            paths = t.column("paths").to_pylist()
            key, groups = _groups(t)
            out = []
            for lo, hi in groups:
                m = hi - lo
                if m < 2:
                    continue
                size = np.diff(at[lo:hi + 1])
                inter = _overlaps(tok_all[at[lo]:at[hi]], np.repeat(np.arange(m), size), m)
                union = size[:, None] + size[None, :] - inter
                i, j = _pairs(inter >= threshold * union - 1e-9, b[lo:hi], key[lo, 1], key[lo, 2])
                if len(i):
                    p = paths[lo:hi]
                    i, j = _first_shared(i, j, key[lo, 0], p, [set(x) for x in p])
                if not len(i):
                    continue
                links = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
                docs = np.bincount(i, copies[lo:hi][j], m) + np.bincount(j, copies[lo:hi][i], m)
                root = np.arange(m)
                while True:  # least label along the links
                    new = root.copy()
                    np.minimum.at(new, i, root[j])
                    np.minimum.at(new, j, root[i])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                some = np.flatnonzero(links)
                out.append((sid[lo:hi][some], sid[lo:hi][root[some]], links[some], docs[some].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["sid", "to", "links", "docs"])
    return run


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``node, root``: the least node of each connected component."""
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours join the least one
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours join the least of them
        down = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(down, "u").select("u", "v", "m")
        e = e.select(F.col("v").alias("u"), F.col("m").alias("v")).union(e.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = stored(e, "stars")
        now = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        if seen == now:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, runs: int | None = None, limit: int = 256, depth: int = 2, block: int = 512,
                    recall: float = 1 - 2e-8) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, class_id, n_links (documents at similarity ``threshold`` or
    more), n_set_links (different shingle sets among them), n_shingles, th (the text's xxhash64, null as empty),
    first (its text is its class's first, by id and th; of repeated rows all).  ``runs`` follow from ``recall`` if not given."""
    runs = runs or runs_for(threshold, recall, depth)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", doc_key().alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = stored(keyed.mapInArrow(_embed(width), "doc_id long, doc long, th long, n int, sid long, embed binary"), "shingle-sets")
    sets = stored(rows.filter("n > 0").groupBy("sid").agg(F.min(F.struct("doc", "th")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("size"),
                                                          F.first("embed").alias("embed")), "distinct-sets")
    leaves = _leaves(sets, runs, limit, depth)
    paths = leaves.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("run", "node"))).alias("p")).select("sid", F.col("p.node").alias("paths"))
    paths = stored(paths, "paths-of-sets")
    n = shuffle_partitions(docs.sparkSession)
    placed = (_blocked(leaves, block).join(paths, "sid").join(sets.select("sid", "size", "embed"), "sid")
              .select(*_KEY, "b", "sid", "size", "paths", "embed").repartition(n, *_KEY).sortWithinPartitions(*_KEY))
    likely = stored(placed.mapInArrow(_screen(threshold), "node long, bi int, bj int, b int, sid long"), "likely")
    asked = (likely.groupBy("sid").agg(F.collect_list(F.struct(*_KEY, "b")).alias("wanted")).join(paths, "sid").join(sets.select("sid", "rep", "copies"), "sid")
             .select(F.col("rep.doc").alias("doc"), F.col("rep.th").alias("th"), "sid", "copies", "paths", "wanted"))
    once = keyed.select("doc", "th", "text").join(asked, ["doc", "th"]).dropDuplicates(["doc", "th"]).select("text", "sid", "copies", "paths", "wanted")
    held = (once.mapInArrow(_tokens(width), "node long, bi int, bj int, b int, sid long, copies long, paths array<long>, tokens binary")
            .repartition(n, *_KEY).sortWithinPartitions(*_KEY))
    links = stored(held.mapInArrow(_verify(threshold), "sid long, to long, links long, docs long"), "set-links")
    counts = links.groupBy("sid").agg(F.sum("links").alias("n_set_links"), F.sum("docs").alias("docs"))
    roots = components(links.select(F.col("sid").alias("u"), F.col("to").alias("v")))
    named = (sets.select("sid", "rep", "copies").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    least = named.groupBy("root").agg(F.min("rep").alias("class"))
    info = named.join(least, "root").join(counts, "sid", "left").select(
        "sid", "class", (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"))
    info = stored(info, "set-classes")
    # texts without words have no set
    named = F.coalesce("class.doc", "doc")
    return (rows.select("doc_id", "doc", "th", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(info, "sid", "left")
            .select("doc_id", F.when(named != F.lit(MAX_LONG), named).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"), F.col("n").alias("n_shingles"), "th",
                    (F.col("class").isNull() | (F.col("class.doc") == F.col("doc")) & (F.col("class.th") == F.col("th"))).alias("first")))
