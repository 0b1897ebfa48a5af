"""From scored pairs (q, s1, p, is_s3) to matches: thresholds, expected F0.5, caps, sweeps, prior shift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import FLOORS, MOST_S2, MOST_S3
from .features import is_best
from .metrics import evaluate, true_counts


def best_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("_best", is_best()).where("_best").drop("_best")


def apply_caps(kept: DataFrame, most_s2: int = MOST_S2, most_s3: int = MOST_S3) -> DataFrame:
    """The most likely pairs of each (s1, source) up to its cap; ties to the smaller q."""
    rank = F.row_number().over(W.partitionBy("s1", "is_s3").orderBy(F.desc("p"), "q"))
    ranked = kept.withColumn("_k", rank).where(F.col("_k") <= max(most_s2, most_s3))  # a limit that Spark pushes below the shuffle
    return ranked.where(F.col("_k") <= F.when(F.col("is_s3"), most_s3).otherwise(most_s2)).drop("_k")


def decide(pairs: DataFrame, threshold: float) -> DataFrame:
    """Each query's best pair if it reaches the threshold, then caps."""
    return apply_caps(best_pairs(pairs).where(F.col("p") >= threshold))


def decide_expected(pairs: DataFrame, floor: float | None = None) -> DataFrame:
    """Per s1 the prefix of its claimants, by falling p, of the largest expected F0.5; none if that is likelier to be right.

    Expected F0.5 of k claimants: 1.25 * (sum of their p) / (0.25 * (sum of all claimants' p) + k); of none:
    the product of all 1 - p. Only claimants of p >= floor are kept. With a column ``floor`` in ``pairs``
    instead of the argument, floors are tried side by side.
    """
    side = ["floor"] if floor is None else []
    by = W.partitionBy(*side, "s1")
    pc = F.least(F.greatest("p", F.lit(0.0)), F.lit(1 - 1e-6))
    best = pairs.withColumn("_best", F.row_number().over(W.partitionBy(*side, "q").orderBy(F.desc("p"), "s1")) == 1).where("_best").withColumn("_pc", pc)
    best = best.withColumns({"_all": F.sum("_pc").over(by), "_none": F.exp(F.sum(F.log1p(-F.col("_pc"))).over(by))})
    order = by.orderBy(F.desc("p"), "q").rowsBetween(W.unboundedPreceding, 0)
    some = best.where(F.col("p") >= (F.col("floor") if floor is None else F.lit(floor)))
    some = some.withColumns({"_k": F.row_number().over(by.orderBy(F.desc("p"), "q")), "_cum": F.sum("_pc").over(order)})
    some = some.withColumn("_f", 1.25 * F.col("_cum") / (0.25 * F.col("_all") + F.col("_k"))).withColumn("_max", F.max("_f").over(by))
    some = some.withColumn("_cut", F.min(F.when(F.col("_f") >= F.col("_max") - 1e-12, F.col("_k"))).over(by))
    kept = some.where((F.col("_max") > F.col("_none")) & (F.col("_k") <= F.col("_cut"))).select(*pairs.columns)
    if not side:
        return apply_caps(kept)
    rank = F.row_number().over(W.partitionBy("floor", "s1", "is_s3").orderBy(F.desc("p"), "q"))
    return kept.withColumn("_k", rank).where(F.col("_k") <= F.when(F.col("is_s3"), MOST_S3).otherwise(MOST_S2)).drop("_k")


def thresholds() -> list[float]:
    """The tried thresholds in order: 0.05 to 0.95 by 0.05, then 0.30 to 0.89 by 0.01."""
    return [round(0.05 * k, 2) for k in range(1, 20)] + [round(0.30 + 0.01 * k, 2) for k in range(60)]


def sweep(pairs: DataFrame, refs: DataFrame, truth: DataFrame, tried: list[float] | None = None) -> DataFrame:
    """(threshold, f05) without caps, for each distinct threshold. refs: (s1); truth: (q, s1).

    One pass over the best pairs: each falls into the interval between two thresholds, counts by s1 and
    interval are summed downwards, and an s1's F0.5 changes only at intervals in which it has pairs.
    """
    grid = sorted(set(thresholds() if tried is None else tried))
    step = F.array(*map(F.lit, grid))
    right = truth.select("q", F.col("s1").alias("true_s1"))
    best = best_pairs(pairs).join(right, "q", "left").withColumn("at", F.size(F.filter(step, lambda t: t <= F.col("p")))).where("at > 0")
    counts = best.groupBy("s1", "at").agg(F.count("*").alias("n"), F.sum(F.when(F.col("s1") == F.col("true_s1"), 1).otherwise(0)).alias("tp"))
    down = W.partitionBy("s1").orderBy(F.desc("at"))
    upto = down.rowsBetween(W.unboundedPreceding, 0)
    runs = counts.withColumns({"n": F.sum("n").over(upto), "tp": F.sum("tp").over(upto), "past": F.coalesce(F.lead("at").over(down), F.lit(0))})
    nt = true_counts(refs, truth)
    f = lambda n, tp, t: F.when(0.25 * t + n > 0, 1.25 * tp / (0.25 * t + n)).otherwise(1.0)
    none = f(F.lit(0), F.lit(0), F.col("n_true"))
    gains = runs.join(nt, "s1").withColumn("gain", f(F.col("n"), F.col("tp"), F.col("n_true")) - none)
    per = gains.withColumn("k", F.explode(F.sequence(F.col("past") + 1, F.col("at")))).groupBy("k").agg(F.sum("gain").alias("gain"))
    base = nt.agg(F.sum(none).alias("base"), F.count("*").alias("refs"))
    grid_rows = pairs.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(grid)], "k int, threshold double")
    return grid_rows.join(per, "k", "left").join(F.broadcast(base)).select("threshold", ((F.col("base") + F.coalesce("gain", F.lit(0.0))) / F.col("refs")).alias("f05"))


def best_threshold(swept: DataFrame, tried: list[float] | None = None) -> tuple[float, float]:
    """The first threshold, in the order they are tried, that is strictly better than those before."""
    f = {r["threshold"]: r["f05"] for r in swept.collect()}  # as many rows as thresholds
    top = (0.5, -1.0)
    for t in thresholds() if tried is None else tried:
        if f[t] > top[1]:
            top = (t, f[t])
    return top


def sweep_expected(pairs: DataFrame, refs: DataFrame, truth: DataFrame, floors: list[float] = FLOORS) -> DataFrame:
    """(floor, f05) of the expected-F rule with caps."""
    tried = decide_expected(pairs.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))))
    return evaluate(tried, refs.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))), truth, side=["floor"]).select("floor", "f05")


def prior_shift(p: Column, prior_train: float, prior_test: float) -> Column:
    """p with its logit moved by the difference of the priors' logits; clipped to 1e-7 on both sides."""
    shift = math.log(prior_test / (1 - prior_test)) - math.log(prior_train / (1 - prior_train))
    pc = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return 1 / (1 + F.exp(-(F.log(pc / (1 - pc)) + shift)))


def auto_prior(matches_per_ref: float, n_refs: int, n_queries: int) -> float:
    return min(0.95, matches_per_ref * n_refs / n_queries)
