import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.operators import decision, features, metrics


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "q long, s1 long, p double, is_s3 boolean")


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(60), rng.randrange(8)): rng.randrange(100) / 100 for _ in range(260)}
    rows = [(q, s, p, q % 2 == 1) for (q, s), p in pairs.items()]
    truth = [(q, rng.randrange(8)) for q in range(0, 60, 2)]
    return rows, frame(spark, rows), truth, spark.createDataFrame(truth, "q long, s1 long"), spark.range(8).withColumnRenamed("id", "s1")


def best(rows):
    out = {}
    for q, s, p, three in rows:
        if q not in out or (-p, s) < (-out[q][2], out[q][1]):
            out[q] = (q, s, p, three)
    return list(out.values())


def capped(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1], r[3]].append(r)
    return {r[:2] for (_, three), rs in by.items() for r in sorted(rs, key=lambda r: (-r[2], r[0]))[: 6 if three else 5]}


def ids(df):
    return {(r["q"], r["s1"]) for r in df.collect()}


def test_threshold_and_caps(cases):
    rows, df, *_ = cases
    assert ids(decision.decide(df, 0.3)) == capped([r for r in best(rows) if r[2] >= 0.3])


@pytest.mark.parametrize("floor", [0.05, 0.5])
def test_expected(cases, floor):
    rows, df, *_ = cases
    by = defaultdict(list)
    for r in best(rows):
        by[r[1]].append(r)
    kept = []
    for rs in by.values():
        pc = lambda r: min(r[2], 1 - 1e-6)
        every, none = sum(map(pc, rs)), math.prod(1 - pc(r) for r in rs)
        order = sorted((r for r in rs if r[2] >= floor), key=lambda r: (-r[2], r[0]))
        values = [1.25 * sum(map(pc, order[: k + 1])) / (0.25 * every + k + 1) for k in range(len(order))]
        if values and max(values) > none:
            kept += order[: next(k for k, v in enumerate(values) if v >= max(values) - 1e-12) + 1]
    assert ids(decision.decide_expected(df, floor)) == capped(kept)


def test_sweep_is_the_plain_evaluation_without_caps(cases):
    rows, df, truth, t, refs = cases
    right = dict(truth)
    swept = {r["threshold"]: r["f05"] for r in decision.sweep(df, refs, t).collect()}
    for at in (0.05, 0.3, 0.62, 0.95):
        kept = [r for r in best(rows) if r[2] >= at]
        f = []
        for s in range(8):
            n, true = sum(r[1] == s for r in kept), sum(v == s for v in right.values())
            tp = sum(r[1] == s and right.get(r[0]) == s for r in kept)
            f.append(1.25 * tp / (0.25 * true + n) if 0.25 * true + n else 1.0)
        assert swept[at] == pytest.approx(sum(f) / 8)
    assert decision.best_threshold(decision.sweep(df, refs, t))[1] == pytest.approx(max(swept.values()))


@pytest.mark.parametrize("true, hit, predicted, want", [(2, 2, 3, 0.714), (0, 0, 0, 1.0), (0, 0, 1, 0.0), (4, 4, 5, 0.833), (4, 3, 3, 0.9375)])
def test_f05_examples(spark, true, hit, predicted, want):
    refs = spark.createDataFrame([(1,)], "s1 long")
    truth = spark.createDataFrame([(i, 1) for i in range(true)], "q long, s1 long")
    pred = spark.createDataFrame([(i if i < hit else 100 + i, 1) for i in range(predicted)], "q long, s1 long")
    assert metrics.per_ref_f05(pred, refs, truth).first()["f05"] == pytest.approx(want, abs=1e-3)


def test_perfect_predictions_score_one_and_partitions_do_not_matter(cases):
    _, df, _, t, refs = cases
    assert metrics.evaluate(t, refs, t).first()["f05"] == 1.0
    assert ids(decision.decide(df.repartition(7), 0.3)) == ids(decision.decide(df.coalesce(1), 0.3))


def test_group_features_with_records(spark, cases):
    rows, df, *_ = cases
    records = df.select("q").distinct().select("q", F.concat(F.lit("name "), F.col("q").cast("string")).alias("name_key"), F.lit("").alias("addr_clean"))
    got = features.group_features(df, records).collect()
    assert len(got) == len(rows)
    assert all((r["g_other_nk_ratio"] >= 0) == r["g_has_other"] and (r["g_other_ad_tset"] == 0) == r["g_has_other"] for r in got)


def test_prior_shift_is_the_identity_for_equal_priors(spark):
    p = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "p double").select(decision.prior_shift(F.col("p"), 0.4, 0.4)).collect()
    assert [round(r[0], 6) for r in p] == [0.0, 0.3, 1.0]


def test_empty(spark):
    none = frame(spark, [])
    assert decision.decide(none, 0.5).count() == decision.decide_expected(none, 0.1).count() == features.group_features(none).count() == 0
