"""The URL query and synthetic trees against a plain form of the path-template tree."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm.queries import URL_RULES, op7_url_templates
from kinfold.llm.url_filter import filter_urls


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def general(path):
    return tuple(re.sub("[0-9]+", "*", re.sub(r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", "*", s)) for s in path.split("/") if s)


def judge(urls, good_of, most=24, rare=5, most_fixed=10_000, z=1.96, prior=10.0, least=0.5, min_seen=5):
    """good_of: for each url True, False or None. Returns (host, path, rule, verdict, template, purity) for each."""
    rows = defaultdict(lambda: [0, 0, 0])
    where = []
    for u, good in zip(urls, good_of, strict=True):
        host, path = parts(u)
        where.append((host, path, key := (host, general(path))))
        rows[key][0] += 1
        rows[key][1] += good is True
        rows[key][2] += good is False
    template = dict.fromkeys(rows, "")
    for level in range(max((len(key[1]) for key in rows), default=0)):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for key, c in rows.items():
            if len(key[1]) > level:
                child = nodes[key[0], template[key]][key[1][level]]
                for i in range(3):
                    child[i] += c[i]
        named = {}
        for node, children in nodes.items():
            if len(children) > most and (2 * sum(c[0] < rare for c in children.values()) >= len(children) or len(children) > most_fixed):
                named |= {(node, child): "*" for child in children}
                continue
            runs, pool = [], (0, 0)
            for few, rate, child, g, b in sorted((g + b < min_seen, (g + 1) / (g + b + 2), child, g, b) for child, (_, g, b) in children.items()):
                n = sum(pool)
                p = (pool[0] + 1) / (n + 2)
                if not few and n >= min_seen and rate - p <= z * math.sqrt(rate * (1 - rate) / (g + b) + p * (1 - p) / n):
                    runs[-1].append(child)
                    pool = pool[0] + g, pool[1] + b
                else:
                    runs.append([child])
                    pool = g, b
            for run in runs:
                named |= {(node, child): run[0] if len(run) == 1 else "{" + "|".join(sorted(run)) + "}" for child in run}
        for key in rows:
            if len(key[1]) > level:
                template[key] += "/" + named[(key[0], template[key]), key[1][level]]
    totals, hosts, leaves = [0, 0], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for key, (_, g, b) in rows.items():
        for t in (totals, hosts[key[0]], leaves[key[0], template[key]]):
            t[0] += g
            t[1] += b
    p0 = (totals[0] + 1) / (sum(totals) + 2)
    out = []
    for host, path, key in where:
        g, b = hosts[host]
        p1 = (g + prior * p0) / (g + b + prior)
        g, b = leaves[host, template[key]]
        purity = (g + prior * p1) / (g + b + prior)
        rule, verdict = rule_of(host, path)
        out.append((host, path, rule, verdict or ("block" if sum(totals) and purity < least else "allow"), template[key], round(purity, 9)))
    return out


def rows(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 9)) for r in df.collect()}


def test_query(spark, sf_dir):
    pages = sorted((r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect())
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    number = [re.search(r"/([0-9]{1,18})[^/]*/?$", parts(u)[1]) for _, u in pages]
    want = judge([u for _, u in pages], [labels.get(int(m[1])) if m else None for m in number])
    assert rows(op7_url_templates(spark, sf_dir)) == dict(zip((i for i, _ in pages), want, strict=True))


def compare(spark, urls, good, least, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good) if g is not None], "key long, good boolean")
    got = rows(filter_urls(pages, labels, URL_RULES, label_key=F.col("page_id"), min_purity=least, **options))
    names = {"max_children": "most", "rare_pages": "rare"}
    want = judge(urls, good, least=least, **{names.get(k, k): v for k, v in options.items()})
    assert [got[i] for i in range(len(urls))] == want
    return want


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"max_children": 3, "rare_pages": 20}), (3, {"max_children": 3, "most_fixed": 5, "min_seen": 1})])
def test_random_trees(spark, seed, options):
    rng = random.Random(seed)
    urls, good = [], []
    for _ in range(900):
        host = rng.choice(("a.org", "b.org", "x.net", "y.com"))
        depth = rng.randrange(5)
        segments = [rng.choice(("news", "blog", "spam", "cafe1234", "deadbeef00", "p7", "")) if d < 2 else "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 6))) for d in range(depth)]
        urls.append(f"http://{host}/{'/'.join(segments)}")
        good.append(rng.choice((None, rng.random() > 0.9 if "spam" in segments else rng.random() > 0.2)))
    want = compare(spark, urls, good, 0.7, **options)
    assert {v for *_, v, _, _ in want} == {"allow", "block"}
    assert any("{" in t for *_, t, _ in want)


def test_deep_tree(spark):
    """Labels tell branches apart at the twentieth level only."""
    rng = random.Random(4)
    urls, good = [], []
    for i in range(240):
        end = ("fine", "also", "spam")[i % 3]
        urls.append("http://deep.org/" + "/".join("ab"[i % 2] if d == 10 else f"s{'abcdefghijklmnopqrst'[d]}" for d in range(19)) + f"/{end}/{i}")
        good.append(rng.random() > (0.9 if end == "spam" else 0.1))
    want = compare(spark, urls, good, 0.5)
    assert {(v, t.split("/")[20]) for *_, v, t, _ in want} == {("allow", "{also|fine}"), ("block", "spam")}
    assert {t.split("/")[11] for *_, t, _ in want} == {"{a|b}"}


def test_slugs_are_a_wildcard_whatever_the_size_of_the_host(spark):
    slugs = ["".join(chr(97 + int(d)) for d in str(1000 + i)) for i in range(300)]
    for fixed in (1, 40):
        urls = [f"http://h.org/post/{s}" for s in slugs] + [f"http://h.org/{p}/x" for p in ("a", "b", "c") for _ in range(100 * fixed)]
        want = compare(spark, urls, [None] * len(urls), 0.5)
        assert {t for *_, t, _ in want} == {"/post/*", "/a/x", "/b/x", "/c/x"}


def test_branches_that_differ_are_not_chained(spark):
    """Neighbours in a row of branches are alike, its ends are not."""
    urls, good = [], []
    for k in range(9):
        for i in range(400):
            urls.append(f"http://c.org/{'abcdefghi'[k]}/x")
            good.append(i < 400 * (0.1 + 0.1 * k * 0.6))
    want = compare(spark, urls, good, 0.5)
    assert len({t for *_, t, _ in want}) > 3


def test_branches_with_a_label_each_stay_apart(spark):
    urls = [f"http://one.org/{c}/x" for c in "abcd"]
    assert {t for *_, t, _ in compare(spark, urls, [True, False, True, False], 0.5)} == {f"/{c}/x" for c in "abcd"}
