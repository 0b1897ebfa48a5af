"""The whole run on a small made-up data set: every stage through the command line, then the quality rules."""

import random

from pyspark.sql import functions as F

from kinfold.operators import retrieval
from kinfold.plans import cli, model, stages
from kinfold.sources import tsv
from kinfold.streaming.scoring import link_stream

WORDS = "alder birch cedar elder hazel juniper larch maple oak pine rowan spruce willow yew aspen beech".split()


def made(root, seed):
    rng = random.Random(seed)
    rows, truth, n = {"s1": [], "s2": [], "s3": []}, [], 0
    for i in range(120):
        name = " ".join(rng.sample(WORDS, 3)) + " Ltd."
        address = f"{rng.randrange(1, 900)} {rng.choice(WORDS)} Street, Texas"
        country = rng.choice(["US", "India"])
        rows["s1"].append((f"S1-{i:04d}", name, address, country))
        found = []
        for k in ("s2", "s3"):
            for _ in range(rng.randrange(3)):
                n += 1
                id_ = f"{k.upper()}-{n:05d}"
                rows[k].append((id_, name.replace("e", "3", 1), address if rng.random() < 0.8 else "", country))
                found.append(id_)
        truth.append((f"S1-{i:04d}", ",".join(found)))
    for j in range(60):
        rows["s2" if j % 2 else "s3"].append((f"S{2 if j % 2 else 3}-9{j:04d}", " ".join(rng.sample(WORDS, 3)), f"{j} elsewhere road", "US"))
    for split in ("train", "test"):
        (root / split).mkdir(parents=True, exist_ok=True)
        for k, file in tsv.SPLIT_FILES[split].items():
            head, body = ("entity_id\tbusiness_name\tbusiness_address\tcountry", rows[k]) if k != "gt" else ("source1_entity_id\tmatched_entity_ids", truth)
            (root / split / file).write_text(head + "\n" + "".join("\t".join(r) + "\n" for r in body), encoding="utf-8")


def test_all_stages(spark, tmp_path):
    made(tmp_path / "data", 1)
    base = ["--data", str(tmp_path / "data"), "--work", str(tmp_path / "work"), "--out", str(tmp_path / "out")]
    run = lambda *a: cli.main([*a, *base], spark)
    assert run("all", "--rounds", "4", "--depth", "4", "--val-frac", "0.3", "--train-query-frac", "0.9", "--dim", "256") == 0
    assert run("validate", "--matching", str(tmp_path / "out" / "matching_results.tsv"), "--candidate", str(tmp_path / "out" / "candidate_pairs.tsv"), "--check-ids") == 0
    truth = {r[0]: set(filter(None, r[1].split(","))) for r in tsv.read_ground_truth(spark, str(tmp_path / "data" / "train" / "train_ground_truth.tsv")).collect()}
    got = {r[0]: set(filter(None, r[1].split(","))) for r in tsv.read_table(spark, str(tmp_path / "out" / "matching_results.tsv")).collect()}
    f = [1.25 * len(got[k] & t) / (0.25 * len(t) + len(got[k])) if t or got[k] else 1.0 for k, t in truth.items()]
    assert sum(f) / len(f) > 0.8
    meta = model.load_meta(spark, str(tmp_path / "work" / "model" / "meta.json"))
    assert set(meta.stages) == {"stage1", "stage2"}
    stage1, stage2 = model.load_models(spark, str(tmp_path / "work" / "model"), meta)
    assert len(model.importances(stage1[0], model.Settings().columns)) == 15 and stage2 is not None
    assert run("predict", "--threshold", "0.9", "--prob", "p1", "--prior-test", "auto", "--out-name", "other.tsv") == 0
    # scores and fold models are taken over
    scores = tmp_path / "work" / "test" / "scores" / "_SUCCESS"
    stamp = scores.stat().st_mtime_ns
    assert run("predict", "--threshold", "0.5") == 0 and scores.stat().st_mtime_ns == stamp
    fold = tmp_path / "work" / "model" / "stage1_fold0" / "metadata" / "_SUCCESS"
    stamp = fold.stat().st_mtime_ns
    assert run("train", "--rounds", "4", "--depth", "4", "--val-frac", "0.3", "--train-query-frac", "0.9", "--no-stage2") == 0 and fold.stat().st_mtime_ns == stamp
    # a second retrieval with equal parameters keeps what is there
    before = (tmp_path / "work" / "train" / "candidates" / "_SUCCESS").stat().st_mtime_ns
    assert run("retrieve", "--dim", "256") == 0
    assert (tmp_path / "work" / "train" / "candidates" / "_SUCCESS").stat().st_mtime_ns == before
    assert cli.main(["sample", "--data", str(tmp_path / "data"), "--out", str(tmp_path / "small"), "--fraction", "0.3"], spark) == 0
    kept = tsv.read_ground_truth(spark, str(tmp_path / "small" / "train" / "train_ground_truth.tsv")).count()
    assert 0 < kept < 120 and tsv.read_source(spark, str(tmp_path / "small" / "test" / "test_source1.tsv")).count() == kept


def records(spark, rows, key):
    out = spark.createDataFrame(rows, f"{key} long, country string, name_key string, addr_clean string")
    return out.withColumn("addr_empty", F.col("addr_clean") == "").withColumn("is_s3", F.lit(False))


def test_sketched_retrieval_agrees_with_the_exact_one(spark):
    rng = random.Random(2)
    made_up = lambda n: [(i, rng.choice("ab"), " ".join(rng.sample(WORDS, 2)), " ".join(rng.sample(WORDS, 3))) for i in range(n)]
    ref, queries = records(spark, made_up(60), "s1"), records(spark, made_up(40), "q")
    exact = {(r["q"], r["s1"]): r["comb"] for r in retrieval.score_pairs(ref, queries).collect()}
    got = {(r["q"], r["s1"]): r["comb"] for r in retrieval.retrieve_sketched(ref, queries, dim=4096, block=16).collect()}
    assert got and all(abs(exact.get(k, 0) - v) < 0.1 for k, v in got.items())
    best = lambda d: {q: max((v, -s) for (p, s), v in d.items() if p == q)[1] for q in {q for q, _ in d}}
    agree = [best(exact)[q] == s for q, s in best(got).items()]
    assert sum(agree) / len(agree) > 0.9


def test_countries_that_are_done_are_taken_over(spark, tmp_path):
    rng = random.Random(3)
    made_up = lambda n: [(i, rng.choice("abc"), " ".join(rng.sample(WORDS, 2)), " ".join(rng.sample(WORDS, 3))) for i in range(n)]
    ref, queries = records(spark, made_up(60), "s1"), records(spark, made_up(40), "q")
    params = {"k_name": 3, "k_addr": 3, "k_comb": 8, "w_name": 0.5, "dim": 512, "exact": False}
    run = lambda **k: sorted(map(tuple, stages._by_countries(ref, queries, str(tmp_path), "test", params, **k).collect()))
    whole = sorted(tuple(r) for r in retrieval.retrieve_sketched(ref, queries, dim=512).collect())
    assert run() == whole and run(together=1) == whole
    folders = sorted((tmp_path / "test" / "countries").glob("pairs-*"))
    assert len(folders) == 4
    stamps = {f: (f / "_SUCCESS").stat().st_mtime_ns for f in folders}
    (folders[0] / "_SUCCESS").unlink()
    assert run(together=1) == whole and run() == whole
    assert sum((f / "_SUCCESS").stat().st_mtime_ns != t for f, t in stamps.items()) == 1


def test_empty_and_foreign_queries_have_no_candidates(spark):
    ref = records(spark, [(1, "a", "oak", "pine")], "s1")
    queries = records(spark, [(1, "a", "", ""), (2, "z", "oak", "pine"), (3, "a", "oak", "")], "q")
    assert {(r["q"], r["s1"], round(r["comb"], 6)) for r in retrieval.score_pairs(ref, queries).collect()} == {(3, 1, 1.0)}


def test_stream(spark, tmp_path):
    ref = records(spark, [(1, "a", "oak elm", "pine road"), (2, "a", "larch", "yew street")], "s1")
    queries = records(spark, [(7, "a", "oak elm", "pine road"), (8, "a", "nothing", "like it")], "q")
    queries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    link_stream(ref, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [(r["q"], r["s1"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(7, 1)]
