"""URL filter: parsing, rules, wildcards, merging, purity."""

import random
import re
import string

from pyspark.sql import functions as F

from intentloom.llm.queries import RULES, op5
from intentloom.llm.url_filter import judge_urls, path_templates
from tests.conftest import SF_SMALL


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path


def rule_of(host, path):
    best = None
    for v, r in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return best


def test_rules_and_parsing(spark):
    urls = [None, "", "no scheme", "http://", "http://a.NET", "http://a.net/", "HTTP://x.example.NET/en/1?q#f", "x://example.com/de/", "http://é.ÀB.org/fr/x",
            "http://notexample.net/en/", "http://h?://x/y", "a://b://c/d", "http://example.com/de", "http://net/", "http://q.net?x", "http://q.org#/fr/", "http://org/fr/\n/x"]
    df = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)] + [(None, "http://z.net/", 0, "h")], "page_id long, url string, bad int, host string")
    got = judge_urls(df, RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = "http://z.net/" if r.page_id is None else urls[r.page_id]
        host, path = parse(u)
        want = rule_of(host, path)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((want[1], want[0]) if want else (None, "allow"))


def test_table(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = op5(spark, SF_SMALL).collect()
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        assert (r.host, r.path) == parse(pages[r.page_id])
        want = rule_of(r.host, r.path)
        assert r.verdict in ("allow", "block") and (r.rule, r.verdict if want else None) == ((want[1], want[0]) if want else (None, None))


def test_templates(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(4000):
        kind = rnd.choice(["spam", "news", "blog", "shop"])
        bad = int(rnd.random() < (0.95 if kind == "spam" else 0.05))
        rows.append((i, f"http://h/{kind}/{i}/view/", bad if i % 2 else None))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = judge_urls(df, []).collect()
    kinds = {u.split("/")[3]: set() for _, u, _ in rows}
    for r in got:
        kinds[r.path.split("/")[1]].add((r.template, r.verdict))
    assert kinds["spam"] == {("/spam/*/*/", "block")} or kinds["spam"] == {("/spam/*/view/", "block")}
    # branches with the same purity are one template, and pages without a label are judged too
    merged = kinds["news"] | kinds["blog"] | kinds["shop"]
    assert all(v == "allow" for _, v in merged) and not any(t.startswith("/spam") for t, _ in merged)


def test_smoothing_needs_evidence(spark):
    df = spark.createDataFrame([(1, "http://one/x", 1)] + [(i, "http://big/y", 0) for i in range(2, 50)], "page_id long, url string, bad int")
    assert {r.host: r.verdict for r in judge_urls(df, []).collect()} == {"one": "allow", "big": "allow"}


def test_deep_paths_and_empty(spark):
    deep = spark.createDataFrame([("h", "/" + "/".join(map(str, range(20))), None)], "host string, path string, bad int")
    assert path_templates(deep, max_depth=3).first().template == "/*/*/*/**"
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, bad int"), RULES).count() == 0
    assert judge_urls(deep.select(F.lit(1).alias("page_id"), F.lit(None).cast("string").alias("url"), "bad"), RULES).first().template == ""


def brute_tree(pages, min_support=20, z=2.58, smooth=10.0, reject=0.5):
    """page_id -> (template, verdict) without rules, for ``pages(page_id, url, bad)``, by a tree per host in plain Python."""
    template, nodes = {}, {}
    for i, url, bad in pages:
        host, path = parse(url)
        nodes.setdefault((host, "", 0), []).append((i, host, path, [s for s in path.split("/") if s], bad))
    labels = lambda rows: [r[4] for r in rows if r[4] is not None]
    while nodes:
        (host, name, d), rows = nodes.popitem()
        kids = {}
        for r in rows:
            if len(r[3]) == d:
                template[r[0]] = (host, name + ("/" if r[2].endswith("/") else ""), r[4])
            else:
                kids.setdefault(r[3][d], []).append(r)
        often = {s: k for s, k in kids.items() if len(k) >= min_support and labels(k)}
        classes = {}
        for s, k in kids.items():
            lab = labels(k)
            classes.setdefault(sum(lab) * 1000 // len(lab) if s in often else -1, []).append(s)
        pool = [[set(ss), labels([r for s in ss for r in kids[s]]), step < 0] for step, ss in sorted(classes.items())]
        pool = sorted((c for c in pool if c[1]), key=lambda c: sum(c[1]) / len(c[1]))
        while len(pool) > 1:
            best = None
            for i in range(len(pool) - 1):
                a, b = pool[i][1], pool[i + 1][1]
                p = (sum(a) + sum(b)) / (len(a) + len(b))
                gap, noise = abs(sum(a) / len(a) - sum(b) / len(b)), (p * (1 - p) * (1 / len(a) + 1 / len(b))) ** 0.5
                far = gap / noise if noise else (0.0 if gap == 0 else float("inf"))
                if best is None or far < best[0] - 1e-12:
                    best = (far, i)
            if best[0] > z:
                break
            i = best[1]
            pool[i:i + 2] = [[pool[i][0] | pool[i + 1][0], pool[i][1] + pool[i + 1][1], pool[i][2] or pool[i + 1][2]]]
        star = next((c for c in pool if c[2]), max(pool, key=lambda c: sum(len(kids[s]) for s in c[0])) if pool else None)
        name_of = {}
        for n, c in enumerate(pool):
            for s in c[0] if c is not star else ():
                name_of[s] = s if len(c[0]) == 1 else f"*{n}"
        total = sum(map(len, kids.values()))
        for s, k in kids.items():
            nodes.setdefault((host, f"{name}/{name_of.get(s, '*') if total >= min_support else '*'}", d + 1), []).extend(k)
    every = [b for _, _, b in pages if b is not None]
    groups = {}
    for h, t, b in template.values():
        groups.setdefault((h, t), []).extend([] if b is None else [b])
    share = {g: (sum(b) + smooth * sum(every) / len(every)) / (len(b) + smooth) for g, b in groups.items()}
    return {i: (t, "block" if share[h, t] > reject else "allow") for i, (h, t, _) in template.items()}


def test_tree_equals_brute_force(spark):
    rnd = random.Random(8)
    urls = [(f"http://hot/{rnd.choice('abcd')}/{i}/view/", int(rnd.random() < 0.05)) for i in range(12000)]
    urls += [(f"http://hot/offer/{i}/view/", 1) for i in range(90)]  # less than 1 % of the host
    urls += [(f"http://hot/a/{i}/casino", 1) for i in range(60)]
    deep = "/".join(f"s{k}" for k in range(10))  # apart only from the 11th segment on
    urls += [(f"http://deep/{deep}/{'xy'[i % 2]}/{i}/more", i % 2) for i in range(400)]
    urls += [(f"http://few/{rnd.choice('pq')}/" + "/".join(map(str, range(30))), 1) for _ in range(9)]
    pages = [(i, u, None if rnd.random() < 0.2 else b) for i, (u, b) in enumerate(urls)]
    want = brute_tree(pages)
    got = judge_urls(spark.createDataFrame(pages, "page_id long, url string, bad int").repartition(5), []).collect()
    assert {r.page_id: (r.template, r.verdict) for r in got} == want and len(got) == len(pages)
    verdicts = lambda part: {want[i][1] for i, u, _ in pages if part in u}
    assert verdicts("/offer/") == verdicts("/casino") == verdicts("/y/") == {"block"} and verdicts("/x/") == {"allow"}


def test_alike_siblings_are_judged_together(spark):
    # three branches of 60 pages with 8 of 8 bad labels each, two clean ones, and many pages that vary
    rows = [(f"http://h/{s}/{i}", 1 if i < 8 else None) for s in ("x", "y", "z") for i in range(60)]
    rows += [(f"http://h/{s}/{i}", 0 if i < 30 else None) for s in ("c", "d") for i in range(60)]
    rows += [(f"http://h/page{i}/v", int(i % 4 == 0) if i % 2 else None) for i in range(400)] + [("http://h/*/q", 1)] * 30
    pages = [(i, u, b) for i, (u, b) in enumerate(rows)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, bad int"), []).collect()}
    bad = {got[i].template for i, u, _ in pages if u.split("/")[3] in "xyz"}
    clean = {got[i].template for i, u, _ in pages if u.split("/")[3] in "cd"}
    assert len(bad) == len(clean) == 1 and bad != clean
    assert {got[i].verdict for i, u, _ in pages if u.split("/")[3] in "xyz"} == {"block"} and {got[i].verdict for i, u, _ in pages if u.split("/")[3] in "cd"} == {"allow"}
    want = brute_tree([p for p in pages if "/*/" not in p[1]])
    rest = judge_urls(spark.createDataFrame([p for p in pages if "/*/" not in p[1]], "page_id long, url string, bad int"), []).collect()
    assert {r.page_id: (r.template, r.verdict) for r in rest} == want


def test_long_chains_take_few_rounds(spark, monkeypatch):
    import intentloom.llm.url_filter as m
    rounds = []
    monkeypatch.setattr(m, "stored", lambda df, name, f=m.stored: rounds.append(name) or f(df, name))
    deep = "/".join(f"s{k % 7}" for k in range(5000))
    pages = [(i, f"http://deep/{deep}/{'xy'[i % 2]}/{i}", i % 2) for i in range(120)]
    got = judge_urls(spark.createDataFrame(pages, "page_id long, url string, bad int"), []).collect()
    assert rounds.count("url-children") < 25
    assert {r.verdict for r in got if r.page_id % 2} == {"block"} and {r.verdict for r in got if not r.page_id % 2} == {"allow"}
    assert all(r.template.count("/") == 5002 and r.template.startswith("/*" * 5000) for r in got)


def test_clashing_names_and_long_urls(spark):
    names = "template _seg _at _deep _s n lab step cluster wild segments _name _h _t bad_share rule verdict path host all_n stride share".split()
    df = spark.createDataFrame([(1, "http://a.b/" + "x" * 200_000 + "/y", 1, *names), (2, None, None, *names)], "page_id long, url string, bad int, " + ", ".join(f"{c} string" for c in names))
    assert sorted((r.page_id, len(r.path), r.template) for r in judge_urls(df, []).collect()) == [(1, 200_003, "/*/*"), (2, 0, "")]
