"""Command line: ``python -m kinfold.plans.cli STAGE [options]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators import quality
from ..operators.metrics import format_report
from ..sources import layout
from . import model, stages

STAGES = ["sample", "restore", "prepare", "retrieve", "features", "train", "predict", "persist", "package", "validate", "all"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=STAGES)
    for name, default in (("data", "dataset"), ("work", "work"), ("out", "output"), ("from", "."), ("team", "team"), ("out-name", "matching_results.tsv")):
        p.add_argument(f"--{name}", default=default, dest="source" if name == "from" else None)
    p.add_argument("--split", choices=["train", "test"], default="train")
    p.add_argument("--fraction", type=float, default=0.02)
    p.add_argument("--what", choices=["all", "model", "train", "test"], default="all")
    for name, default in (("k-name", 3), ("k-addr", 3), ("k-comb", 8), ("dim", 1024), ("folds", 2), ("rounds", 1500), ("depth", 9)):
        p.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("w-name", 0.5), ("train-query-frac", 0.35), ("val-frac", 0.02)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--exact", action="store_true", help="retrieve by the inverted index instead of sketches")
    p.add_argument("--drop", choices=["none", "density"], default="none")
    p.add_argument("--no-stage2", action="store_true")
    p.add_argument("--threshold", type=float)
    p.add_argument("--no-candidates", action="store_true")
    p.add_argument("--prob", choices=["auto", "p1", "p2"], default="auto")
    p.add_argument("--prior-test")
    for name in ("matching", "candidate", "test-dir"):
        p.add_argument(f"--{name}")
    p.add_argument("--check-ids", action="store_true")
    return p


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    test = a.test_dir or f"{a.data}/test"
    required = quality.read_ids(spark, f"{test}/test_source1.tsv")
    valid = quality.match_targets(spark, [f"{test}/test_source{k}.tsv" for k in (2, 3)]) if a.check_ids else None
    report = quality.validate(spark, a.matching or f"{a.out}/matching_results.tsv", required, a.candidate, valid)
    for kind, lines in (("error", report.errors), ("warning", report.warnings)):
        for line in lines:
            print(f"{kind}: {line}")
    print("PASS" if report.passed else "FAIL")
    return int(not report.passed)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.stage == "package":
        print(layout.package({a.out_name: f"{a.out}/{a.out_name}", "candidate_pairs.tsv": f"{a.out}/candidate_pairs.tsv"}, a.source, f"{a.team}.zip"))
        return 0
    spark = spark or SparkSession.builder.appName("kinfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.stage == "restore":
        print("\n".join(layout.restore(spark, a.source, a.work)))
        return 0
    run = ["prepare", "retrieve", "features", "train", "predict", "persist"] if a.stage == "all" else [a.stage]
    for stage in run:
        for split in ("train", "test") if a.stage == "all" and stage in ("prepare", "retrieve", "features") else (a.split,):
            if stage == "prepare":
                stages.prepare(spark, a.data, a.work, split)
            elif stage == "retrieve":
                if report := stages.retrieve(spark, a.work, split, a.k_name, a.k_addr, a.k_comb, a.w_name, a.dim, a.exact):
                    print(format_report(report))
            elif stage == "features":
                stages.make_features(spark, a.work, split)
        if stage == "sample":
            stages.sample(spark, a.data, a.out, a.fraction)
        elif stage == "train":
            settings = model.Settings(folds=a.folds, rounds=a.rounds, depth=a.depth, val_share=a.val_frac, train_share=a.train_query_frac, drop=a.drop, stage2=not a.no_stage2)
            print(stages.train(spark, a.work, settings))
        elif stage == "predict":
            stages.predict(spark, a.work, a.out, a.threshold, not a.no_candidates, a.prob, a.prior_test, a.out_name)
        elif stage == "persist":
            print("\n".join(layout.persist(spark, a.work, a.out, a.what)))
        elif stage == "validate":
            return validate(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
