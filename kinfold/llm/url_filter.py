"""URL filter by path-template trees, in DataFrame operations only.

Per host, the paths make a tree of segments. Level by level, down to the deepest path, segments become
wildcards: digits and long hex runs at once, and all children of a node that has many, most of them with few
pages each, which holds for a node of slugs however large its host is. Then branches of a node that carry
labels enough and whose shares of good pages don't differ significantly are merged: in the order of that
share, a branch joins the run before it if a two-proportion test against the run's pooled counts lets it.
What is left of a path when the tree ends is its template; its purity is the share of good labelled pages,
smoothed towards its host's, and that towards the whole table's. Pages of a template below ``min_purity``
are blocked, others allowed.

Everything after the first aggregate works on distinct (host, generalised path) rows, so a host with
a third of all pages is combined before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[tuple[str, str, str]], host: str, path: str) -> Column:
    """(rule, verdict) of the longest fitting rule of (verdict, host, path start), else null. A rule fits its host's subdomains too."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(start)
        out = F.when(fits, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _generalised(path: str) -> Column:
    """The segments of a path with hex runs of 8 or more that hold a digit, and digit runs, as wildcards."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", "*"), r"[0-9]+", "*"))


def _runs(children: Column, z: float, min_seen: int) -> Column:
    """The run of each of these (few, rate, child, good, bad), sorted, as an array of numbers; one pass that keeps the run's pooled counts."""

    def step(state: Column, c: Column) -> Column:
        pooled, seen = state["good"] + state["bad"], c["good"] + c["bad"]
        rate = (state["good"] + 1) / (pooled + 2)
        error = F.sqrt(c["rate"] * (1 - c["rate"]) / F.greatest(seen, F.lit(1)) + rate * (1 - rate) / F.greatest(pooled, F.lit(1)))
        joins = (seen >= min_seen) & (pooled >= min_seen) & (c["rate"] - rate <= z * error)
        run = F.when(joins, state["run"]).otherwise(state["run"] + 1)
        kept = lambda x: F.when(joins, state[x] + c[x]).otherwise(c[x])
        return F.struct(F.concat(state["runs"], F.array(run)).alias("runs"), run.alias("run"), kept("good").alias("good"), kept("bad").alias("bad"))

    none = F.lit(0).cast("bigint")
    start = F.struct(F.array().cast("array<int>").alias("runs"), F.lit(0).alias("run"), none.alias("good"), none.alias("bad"))
    return F.aggregate(children, start, step, lambda state: state["runs"])


def path_templates(paths: DataFrame, max_children: int, rare_pages: int, most_fixed: int, z: float, min_seen: int) -> DataFrame:
    """(host, segments, n, good, bad) with its template: wildcards and merged branches, a branching node after the other.

    What all paths of a node have in common is passed over at once, so there are as many rounds as the most
    branching nodes that lie along one path.
    """
    tree, done, level = paths.withColumn("template", F.lit("")).withColumn("at", F.lit(0)), [], 0
    common_part = F.expr("aggregate(sequence(1, least(size(lo), size(hi))), 0, (n, i) -> if(n = i - 1 and lo[i - 1] = hi[i - 1], i, n))")
    while not tree.isEmpty():
        rest = F.slice("segments", F.col("at") + 1, F.size("segments"))
        ends = tree.groupBy("host", "template").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
        ends = ends.select("host", "template", F.when(F.size("lo") == 0, 0).otherwise(common_part).alias("more"))
        passed = F.transform(F.slice("segments", F.col("at") + 1, F.col("more")), lambda s: F.concat(F.lit("/"), s))
        tree = tree.join(ends, ["host", "template"]).withColumn("template", F.concat("template", F.array_join(passed, ""))).withColumn("at", F.col("at") + F.col("more")).drop("more")
        tree = common.cut(tree, f"common{level}")
        done.append(tree.where(F.size("segments") <= F.col("at")).drop("at"))
        tree = tree.where(F.size("segments") > F.col("at"))
        here = F.get("segments", F.col("at"))
        children = tree.groupBy("host", "template", here.alias("child")).agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
        node = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") < rare_pages, 1).otherwise(0)).alias("rare"))
        # a fixed node has at most ``most_fixed`` children, so that its array is bounded
        variable = (F.col("kinds") > max_children) & ((2 * F.col("rare") >= F.col("kinds")) | (F.col("kinds") > most_fixed))
        placed = children.join(node.select("host", "template", variable.alias("variable")), ["host", "template"])
        rate, seen = (F.col("good") + 1) / (F.col("good") + F.col("bad") + 2), F.col("good") + F.col("bad")
        entry = F.struct((seen < min_seen).alias("few"), rate.alias("rate"), "child", "good", "bad")
        sets = placed.where("not variable").groupBy("host", "template").agg(F.array_sort(F.collect_list(entry)).alias("s"))
        runs = sets.select("host", "template", F.explode(F.arrays_zip(F.col("s.child").alias("child"), _runs(F.col("s"), z, min_seen).alias("run"))).alias("r"))
        names = runs.groupBy("host", "template", "r.run").agg(F.array_sort(F.collect_list("r.child")).alias("kinds"))
        name = F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("kinds", "|"), F.lit("}")))
        fixed = names.select("host", "template", name.alias("named"), F.explode("kinds").alias("child"))
        wild = placed.where("variable").select("host", "template", F.lit("*").alias("named"), "child")
        tree = tree.withColumn("child", here).join(fixed.unionByName(wild), ["host", "template", "child"])
        tree = tree.withColumns({"template": F.concat("template", F.lit("/"), "named"), "at": F.col("at") + 1}).drop("child", "named")
        tree = common.cut(tree, f"level{level}")
        level += 1
    return reduce(DataFrame.unionByName, done) if done else tree.drop("at")


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]],
    url_col: str = "url",
    label_key: Column | None = None,
    max_children: int = 24,
    rare_pages: int = 5,
    most_fixed: int = 10_000,
    z: float = 1.96,
    min_seen: int = 5,
    prior: float = 10.0,
    min_purity: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict (allow or block); columns of these names are replaced.

    labels: (key, good) with a key for each labelled document; ``label_key`` gives a page's key from
    the columns of ``pages``, host and path, null for none. A node's children become a wildcard if they are
    more than ``max_children`` and at least half of them have fewer than ``rare_pages`` pages, or if they are
    more than ``most_fixed``. Branches with fewer than ``min_seen`` labels are not merged. A null url, or one without ``://``, has an empty host and path and is a template of
    its own. Repeated labels of a key count as good only if all are; null labels are none. Without any
    label the purity is 0.5 + the prior's share and nothing is blocked but by rules. Repeated pages count as
    often as they come. An empty table gives an empty result.
    """
    names = ("host", "path", "rule", "template", "purity", "verdict")
    base = pages.drop(*names).withColumns({"host": url_host(url_col), "path": url_path(url_col)})
    base = base.withColumns({"__segments": _generalised("path"), "__rule": longest_rule(rules, "host", "path")})
    known = labels.where("key is not null and good is not null").groupBy("key").agg(F.min("good").alias("good"))
    keys = base.select("host", "__segments", (label_key if label_key is not None else F.lit(None).cast("bigint")).alias("key"))
    keys = keys.groupBy("host", "__segments", "key").agg(F.count("*").alias("n"))
    counted = keys.join(known, "key", "left").groupBy("host", F.col("__segments").alias("segments")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(~F.col("good"), F.col("n")).otherwise(0)).alias("bad")
    )
    tree = common.cut(path_templates(common.cut(counted, "paths"), max_children, rare_pages, most_fixed, z, min_seen), "templates")
    whole = tree.agg(((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 2)).alias("p0"))
    by_host = tree.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb")).join(F.broadcast(whole))  # one row
    by_host = by_host.select("host", ((F.col("hg") + prior * F.col("p0")) / (F.col("hg") + F.col("hb") + prior)).alias("p1"))
    leaf = tree.groupBy("host", "template").agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb")).join(by_host, "host")
    purity = (F.col("tg") + prior * F.col("p1")) / (F.col("tg") + F.col("tb") + prior)
    leaf = leaf.select("host", "template", purity.alias("purity"))
    judged = tree.select("host", F.col("segments").alias("__segments"), "template").join(leaf, ["host", "template"])
    any_label = F.lit(not tree.where("good + bad > 0").isEmpty())
    verdict = F.when(any_label & (F.col("purity") < min_purity), "block").otherwise("allow")
    return (
        base.join(judged, ["host", "__segments"])
        .withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce("__rule.verdict", verdict)})
        .drop("__rule", "__segments")
    )
