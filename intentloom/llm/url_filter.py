"""URL filter: explicit rules, and for the rest a path-template tree per host.

Templates grow level by level.  At each node (host and template so far) the next path segments
are counted.  Segments that are frequent there (``min_support`` pages, however large the node is) and labelled are told apart by
their share of bad labels; all others, such as numbers and names that vary from page to page, are one class, the rest.
Siblings that are alike merge: classes are ordered by share, and of all neighbours the two that are most alike (by
the test of proportions) merge again and again until every two neighbours differ at ``z``.  The cluster with the rest
becomes the wildcard ``*`` (if the rest has no labels, the cluster with most pages); a cluster of one segment keeps it literally, one
of several is the class ``*k``, numbered by its share, so that its branches are judged by their labels together.  A finished template is
rejected if its share of bad labels, smoothed towards the corpus' by ``smooth`` pseudo-pages, is above ``reject``.

Plan: only urls are read; every level is one aggregation by (host, template, segment) with partial sums.  Siblings whose
shares agree to a thousandth enter the merging as one, which bounds it to 1,002 classes a node however many segments it has; classes
of all nodes are clustered in parallel.  The names of the segments that are not wildcards, and the nodes that go on, are
joined back (broadcast within a measured size).  A node ends with its paths, or when it has fewer than ``min_support``
pages that go on: from there every segment is a wildcard.  Pages that go on alike pass up to 4,096 segments in one
step, so rounds follow the branching, not the depth.  Only if a ``max_depth`` is given do deeper paths share the
template of their first ``max_depth`` segments and ``**``.

Defined results: a null url or one without ``://`` has an empty host and path and is judged like
any other; a null label does not count; empty tables give no rows; repeated rows are judged
alike; extra columns play no part.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentloom.llm.common import shuffle_partitions, stored, whole_groups
from intentloom.operators.joins import checked_broadcast

_STRIDES = (8, 64, 512, 4096)  # segments that a node without branches passes in one step
_STEPS = 1000                  # of the share of bad labels, below which siblings are one class from the start


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return (F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit("")))


def fitting_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule ``(verdict, 'host/path')`` that fits, as (rule, verdict); nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is tested first
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def merged_shares(lab: list[int], bad: list[int], z: float) -> list[int]:
    """Classes, given by labels and bad labels in the order of their shares -> cluster number of each: the two neighbours
    that are most alike merge as long as the test of proportions cannot tell them apart at ``z``."""
    groups = [[i] for i in range(len(lab))]
    n, b = np.array(lab, float), np.array(bad, float)
    while len(groups) > 1:
        p = (b[1:] + b[:-1]) / (n[1:] + n[:-1])
        gap = np.abs(b[1:] / n[1:] - b[:-1] / n[:-1])
        noise = np.sqrt(p * (1 - p) * (1 / n[1:] + 1 / n[:-1]))
        far = np.divide(gap, noise, out=np.where(gap > 0, np.inf, 0.0), where=noise > 0)
        k = int(far.argmin())
        if far[k] > z:
            break
        groups[k:k + 2] = [groups[k] + groups[k + 1]]
        n[k], b[k] = n[k] + n[k + 1], b[k] + b[k + 1]
        n, b = np.delete(n, k + 1), np.delete(b, k + 1)
    out = [0] * len(lab)
    for c, members in enumerate(groups):
        for m in members:
            out[m] = c
    return out


def _cluster(z: float):
    """Classes sorted by node and share -> ``cluster`` (numbered by share) and whether it is the wildcard: that of
    the node's other segments, or, if these have no label, that with most pages."""
    def run(batches):
        for t in whole_groups(batches, ["host", "template"]):
            host, template = t.column("host").to_pylist(), t.column("template").to_pylist()
            step, lab, bad, n = (t.column(c).to_pylist() for c in ("step", "lab", "bad", "n"))
            cluster, wild, lo = [], [], 0
            while lo < len(host):
                hi = lo + 1
                while hi < len(host) and (host[hi], template[hi]) == (host[lo], template[lo]):
                    hi += 1
                c = merged_shares(lab[lo:hi], bad[lo:hi], z)
                pages = [0] * (max(c) + 1)
                for k, x in zip(c, n[lo:hi]):
                    pages[k] += x
                rest = [k for k, s in zip(c, step[lo:hi]) if s < 0]
                star = rest[0] if rest else pages.index(max(pages))
                cluster += c
                wild += [k == star for k in c]
                lo = hi
            yield from t.append_column("cluster", pa.array(cluster, pa.int32())).append_column("wild", pa.array(wild)).select(
                ["host", "template", "step", "cluster", "wild"]).to_batches()
    return run


def path_templates(urls: DataFrame, *, min_support: int = 20, z: float = 2.58, max_depth: int | None = None) -> DataFrame:
    """``urls(host, path, bad, ...)`` (bad: 1, 0 or null) with a ``template`` column."""
    seg = F.array_remove(F.split("path", "/"), "")
    deepest = F.size("_seg") if max_depth is None else F.least(F.size("_seg"), F.lit(max_depth))
    rows = urls.withColumn("_seg", seg).withColumn("_deep", deepest).withColumn("_at", F.lit(0)).withColumn("template", F.lit(""))
    rows, node = stored(rows, "url-rows"), ["host", "template"]
    while True:
        open_ = rows.filter("_at < _deep").withColumn("_s", F.get("_seg", F.col("_at")))
        # a node whose pages go on alike for many segments passes them in one step
        alike = {k: F.when(F.col("_at") + k <= F.col("_deep"), F.xxhash64(F.slice("_seg", F.col("_at") + 1, k))) for k in _STRIDES}
        child = open_.groupBy(*node, "_s").agg(
            F.count("*").alias("n"), F.count("bad").alias("lab"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"),
            *(f.alias(f"{name}{k}") for k, h in alike.items() for name, f in (("lo", F.min(h)), ("hi", F.max(h)), ("all", F.count(h)))))
        child = stored(child, "url-children")
        nodes = child.groupBy(*node).agg(F.sum("n").alias("all_n"), F.count("*").alias("kids"), *(F.min(f"lo{k}").alias(f"lo{k}") for k in _STRIDES),
                                         *(F.max(f"hi{k}").alias(f"hi{k}") for k in _STRIDES), *(F.sum(f"all{k}").alias(f"all{k}") for k in _STRIDES))
        stride = F.lit(1)
        for k in _STRIDES:
            stride = F.when((F.col(f"all{k}") == F.col("all_n")) & (F.col(f"lo{k}") == F.col(f"hi{k}")), F.lit(k)).otherwise(stride)
        nodes = checked_broadcast(nodes.filter(F.col("all_n") >= min_support).select(*node, stride.alias("stride")))
        if not nodes.limit(1).count():
            break  # deeper nodes are parts of these: no segment is frequent any more
        child = child.join(nodes.select(*node), node, "left_semi")
        frequent = (F.col("n") >= min_support) & (F.col("lab") > 0)
        step = F.when(frequent, F.expr(f"bad * {_STEPS} div lab").cast("int")).otherwise(-1)
        child = stored(child.select(*node, "_s", "n", "lab", "bad", step.alias("step")), "url-steps")
        classes = child.groupBy(*node, "step").agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.count("*").alias("segments"))
        classes = stored(classes.filter("lab > 0").withColumn("share", F.col("bad") / F.col("lab")), "url-classes")
        found = (classes.select(*node, "step", "n", "lab", "bad", "share").repartition(shuffle_partitions(urls.sparkSession), *node)
                 .sortWithinPartitions(*node, "share", "step").mapInArrow(_cluster(z), "host string, template string, step int, cluster int, wild boolean"))
        found = stored(found.filter("not wild"), "url-clusters")
        sizes = found.join(classes.select(*node, "step", "segments"), [*node, "step"]).groupBy(*node, "cluster").agg(F.sum("segments").alias("segments"))
        own = F.when(F.col("_s").startswith("*") | F.col("_s").startswith("\\"), F.concat(F.lit("\\"), "_s")).otherwise(F.col("_s"))
        name = F.when(F.col("segments") == 1, own).otherwise(F.concat(F.lit("*"), F.col("cluster")))
        names = child.filter("step >= 0").join(found, [*node, "step"]).join(sizes, [*node, "cluster"]).select(*node, "_s", name.alias("_name"))
        names = checked_broadcast(names)
        going = open_.join(nodes, node).join(names, [*node, "_s"], "left")
        going = going.withColumn("template", F.when(F.col("stride") == 1, F.concat("template", F.lit("/"), F.coalesce("_name", F.lit("*")))).otherwise(
            F.concat("template", F.repeat(F.lit("/*"), F.col("stride"))))).withColumn("_at", F.col("_at") + F.col("stride"))
        ended = open_.join(nodes.select(*node), node, "left_anti").withColumn("template", _ending()).withColumn("_at", F.col("_deep"))
        rows = rows.filter("_at >= _deep").unionByName(going.select(rows.columns)).unionByName(ended.select(rows.columns))
        rows = stored(rows, "url-rows")
    deeper = F.lit("") if max_depth is None else F.when(F.size("_seg") > max_depth, F.lit("/**")).otherwise(F.lit(""))
    slash = F.when(F.col("path").endswith("/") & (F.col("path") != ""), F.lit("/")).otherwise(F.lit(""))
    return rows.withColumn("template", F.concat(_ending(), deeper, slash)).drop("_seg", "_at", "_deep")


def _ending() -> Column:
    """The template with wildcards for all segments that are left."""
    return F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.col("_deep") - F.col("_at"), F.lit(0))))


def judge_urls(urls: DataFrame, rules: list[tuple[str, str]], *, smooth: float = 10.0, reject: float = 0.5, **tree) -> DataFrame:
    """``urls(page_id, url, bad)`` -> page_id, host, path, rule, verdict, template, bad_share."""
    host, path = host_path(F.col("url"))
    rows = path_templates(urls.select("page_id", host.alias("host"), path.alias("path"), F.col("bad").cast("int").alias("bad")), **tree)
    total = rows.agg(F.count("bad").alias("lab"), F.sum("bad").alias("bad")).first()
    prior = (total["bad"] or 0) / total["lab"] if total["lab"] else 0.0
    shares = (rows.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(
        ((F.sum(F.coalesce("bad", F.lit(0))) + smooth * prior) / (F.count("bad") + smooth)).alias("bad_share")))
    rule, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    return (rows.join(checked_broadcast(shares), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("bad_share") > reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "template", "bad_share"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with ``bad``: the label (low quality or toxic) of the document that the last number of the path names."""
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)[^/0-9?#]*/?(?:[?#].*)?$', 1) as bigint)")
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select("page_id", "url", number.alias("_n")).join(bad, F.col("_n") == F.col("_doc"), "left").select("page_id", "url", "bad")
