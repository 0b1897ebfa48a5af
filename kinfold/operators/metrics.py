"""Macro F0.5 over reference records, its ceiling, and the report on candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def true_counts(refs: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, n_true) for all refs (s1). truth: (q, s1), each q at most once."""
    n = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    return refs.join(n, "s1", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))


def per_ref_f05(predicted: DataFrame, refs: DataFrame, truth: DataFrame, side: list[str] | None = None) -> DataFrame:
    """(s1, n_true, n_pred, tp, f05) for all refs: 1.25 tp / (0.25 n_true + n_pred), 1 if nothing is true or predicted.

    side: further columns of ``predicted`` and ``refs`` that tell runs apart.
    """
    by = [*(side or []), "s1"]
    right = truth.select("q", F.col("s1").alias("true_s1"))
    hits = predicted.join(right, "q", "left")
    counts = hits.groupBy(*by).agg(F.count("*").alias("n_pred"), F.sum(F.when(F.col("s1") == F.col("true_s1"), 1).otherwise(0)).alias("tp"))
    out = true_counts(refs, truth).join(counts, by, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_pred", "tp")})
    floor = 0.25 * F.col("n_true") + F.col("n_pred")
    return out.withColumn("f05", F.when(floor > 0, 1.25 * F.col("tp") / floor).otherwise(1.0))


def evaluate(predicted: DataFrame, refs: DataFrame, truth: DataFrame, side: list[str] | None = None) -> DataFrame:
    """One row (for each side): macro F0.5 in all, over refs without, with one and with several matches, and predicted pairs."""
    f = per_ref_f05(predicted, refs, truth, side)
    of = lambda c, name: F.avg(F.when(c, F.col("f05"))).alias(name)
    measures = [F.avg("f05").alias("f05"), of(F.col("n_true") == 0, "f05_zero"), of(F.col("n_true") == 1, "f05_single"), of(F.col("n_true") > 1, "f05_multi"), F.sum("n_pred").alias("pred_pairs")]
    return (f.groupBy(*side) if side else f.groupBy()).agg(*measures)


def oracle_f05(cands: DataFrame, refs: DataFrame, truth: DataFrame) -> DataFrame:
    """per_ref_f05 of a perfect choice among the candidates."""
    return per_ref_f05(cands.join(truth, ["q", "s1"], "left_semi"), refs, truth)


def candidate_report(cands: DataFrame, refs: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: recall by source, macro recall and ceiling, and numbers of candidates by reference. queries: (q, is_s3)."""
    found = truth.join(cands.select("q", "s1", F.lit(1).alias("found")), ["q", "s1"], "left").join(queries.select("q", "is_s3"), "q").withColumn("found", F.coalesce("found", F.lit(0)))
    rate = lambda c, name: F.avg(F.when(c, F.col("found"))).alias(name)
    recall = found.agg(F.avg("found").alias("pair_recall"), rate(~F.col("is_s3"), "s2_recall"), rate(F.col("is_s3"), "s3_recall"))
    macro = found.groupBy("s1").agg(F.avg("found").alias("r")).agg(F.avg("r").alias("macro_recall"))
    ceiling = oracle_f05(cands, refs, truth).agg(F.avg("f05").alias("oracle_f05"))
    n = refs.join(cands.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    quantile = lambda x, name: F.percentile("n", F.lit(x)).alias(name)
    volume = n.agg(
        F.avg("n").alias("per_ref_mean"), quantile(0.5, "per_ref_median"), quantile(0.9, "per_ref_p90"), quantile(0.95, "per_ref_p95"), quantile(0.99, "per_ref_p99"),
        F.max("n").alias("per_ref_max"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("zero_candidate_refs"), F.sum("n").alias("total_pairs"),
    )
    return recall.join(F.broadcast(macro)).join(F.broadcast(ceiling)).join(F.broadcast(volume))  # one row each


def format_report(report: dict) -> str:
    return "\n".join(f"  {k:24s} {v:.6f}" if isinstance(v, float) else f"  {k:24s} {v:,}" for k, v in report.items())
