"""Boosted trees by tasks that hold the rows, against a plain form; and the scorers that are made together."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim
from kinfold.operators import boosting
from kinfold.plans import model


def made(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.random(n).round(2), rng.integers(0, 3, n), rng.random(n), np.ones(n)], axis=1)
    label = ((x[:, 0] > 0.4) ^ (x[:, 1] == 1) ^ (rng.random(n) < 0.05)).astype(float)
    return x, label


def frame(spark, x, label):
    rows = [(i, *map(float, r), y) for i, (r, y) in enumerate(zip(x, label.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "q long, a double, b double, c double, d double, label double").repartition(5)
    return df.withColumns({"held": F.col("q") % 10 == 0, "fold": (F.col("q") % 2).cast("int"), "part": F.lit("train")})


def plain_tree(x, y, cuts, depth, least):
    """(left, right) by the best cut, or the mean."""
    best = None
    for f in range(x.shape[1]) if depth else ():
        for t in cuts[f]:
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) >= least:
                gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum()
                if best is None or gain > best[0] + 1e-9:
                    best = gain, left, f, t
    if best is None or best[0] - y.sum() ** 2 / len(y) <= 1e-12 * len(y):
        return y.mean()
    _, left, f, t = best
    return f, t, plain_tree(x[left], y[left], cuts, depth - 1, least), plain_tree(x[~left], y[~left], cuts, depth - 1, least)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_are_those_of_the_plain_form(spark):
    x, label = made()
    df, columns = frame(spark, x, label), ["a", "b", "c", "d"]
    b = boosting.Boosting(depth=4, rounds=3, step=0.1, bins=32, min_child=5, subsample=1.0, feature_share=1.0, tolerance=0.0, seed=1)
    df = df.withColumn("held", F.lit(False))
    cuts = boosting.thresholds(df, columns, b.bins)
    assert [len(c) for c in cuts[1:]] == [2, 31, 0] and cuts[1].tolist() == [0.5, 1.5] and len(cuts[0]) <= 31
    whole, odd = boosting.fit(df, columns, [F.lit(True), F.col("fold") == 1], b)
    for fitted, some in ((whole, np.ones(len(x), bool)), (odd, np.arange(len(x)) % 2 == 1)):
        score, y = np.zeros(len(x)), np.where(label > 0, 1.0, -1.0)
        for m in range(b.rounds):
            target = 4 * y / (1 + np.exp(2 * y * score)) if m else y
            tree = plain_tree(x[some], target[some], cuts, b.depth, b.min_child)
            score += (0.1 if m else 1.0) * np.array([plain_value(tree, r) for r in x])
        got = {r["q"]: r["p"] for r in model.score([fitted], df, columns).select("q", "p").collect()}
        assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-2 * score)), atol=1e-9)


def test_the_number_of_jobs_does_not_grow_with_the_trees(spark):
    x, label = made()
    df, columns, jobs = frame(spark, x, label), ["a", "b", "c", "d"], spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boosting", "")
    try:
        fitted = model.fit(df, columns, model.Settings(rounds=20), [F.col("fold") == k for k in range(2)])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("boosting")) < 60  # a job for each level of each tree makes over 200
    assert all(1 < m.getNumTrees <= 20 for m in fitted)
    out = model.score(fitted, df, columns, by_fold=True)
    other = {r["q"]: r["p"] for r in model.score(fitted[:1], df.where("fold = 1"), columns).collect()}
    got = {r["q"]: (r["p"], r["label"]) for r in out.collect()}
    assert len(got) == len(x) and all(abs(got[q][0] - p) < 1e-12 for q, p in other.items())
    assert np.mean([(p > 0.5) == (y > 0.5) for p, y in got.values()]) > 0.9
    assert sum(v for _, v in model.importances(fitted[0], columns)) > 0.99


def test_missing_values_and_nothing_to_learn(spark):
    rows = [(float("nan") if i % 3 == 0 else float(i % 5), float(i % 3 == 0 or i % 5 == 4), False) for i in range(300)]  # missing values go with the highest
    df = spark.createDataFrame(rows, "a double, label double, held boolean")
    (fitted,) = model.fit(df, ["a"], model.Settings(rounds=2), [F.lit(True)])
    assert all((r["p"] > 0.5) == (r["label"] > 0.5) for r in model.score([fitted], df, ["a"]).collect())
    (fitted,) = model.fit(df.withColumn("a", F.lit(1.0)), ["a"], model.Settings(rounds=2), [F.lit(True)])
    assert fitted.trees[0].numNodes == 1


def test_scores_together_are_the_single_ones(spark):
    texts = ["", "oak elm", "elm oak", "oak  elm pine", "pine", "pine" * 30, None, "0ak 3lm", "larch yew street 12"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").coalesce(1)
    singles = {"ratio": sim.col_ratio, "tset": sim.col_token_set, "tsort": sim.col_token_sort, "partial": sim.col_partial, "jw": sim.col_jaro_winkler}
    some = df.where("coalesce(length(a), 0) < 65 and coalesce(length(b), 0) < 65")
    for rows in (df, some):
        for r in rows.withColumn("s", sim.col_scores("a", "b", *singles)).withColumns({c: f("a", "b") for c, f in singles.items()}).collect():
            assert all(abs(r["s"][c] - r[c]) < 1e-9 for c in singles), r
