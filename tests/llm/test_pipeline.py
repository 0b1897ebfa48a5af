"""The pipeline's stages, each against a brute-force form on its own input, and the whole of it."""

import random

from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_groups

import corpus_pipeline as cp


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_whole(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in cp.STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        assert done.columns == cp.COLUMNS
        rows = [tuple(r) for r in done.collect()]
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        if name == "language_id":
            assert {r[:2] for r in rows} == {(d, t) for d, t in before if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            want = brute_lines(sorted(before), 10)
            assert {r[0]: r[1] for r in rows} == {d: t for d, (_, gone, t) in want.items() if not gone or t.strip()}
            assert all(r[4] == len(r[1]) for r in rows)
        elif name == "ngram_jaccard_join":
            assert {r[0] for r in rows} == {c for _, _, c in brute_groups(sorted(before))}
            assert {r[:2] for r in rows} <= before
        else:
            assert {r[:2] for r in rows} <= before
        docs = spark.createDataFrame(rows, docs.select(*cp.COLUMNS).schema)
    pieces = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.where("length > 0").agg({"length": "sum"}).first()[0] == sum(len(r["text"].encode()) for r in docs.collect())


def test_run_is_the_stages_in_turn(spark, sf_dir):
    first = sorted(map(tuple, cp.run(spark, sf_dir).collect()), key=str)
    docs = documents(spark, sf_dir)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(tuple, docs.collect()), key=str) == first and first


def test_edges(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(("thon", "ered", "ing", "haus", "über")) for _ in range(n))
    copy = words(40)
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "123", "en", "a", 3), (4, copy, "en", "a", 9), (4, copy, "en", "a", 9), (5, copy, None, "b", 9), (None, words(60), "de", "a", 1), (6, words(2000), "de", "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, df, "")
        assert df.columns == cp.COLUMNS
    assert df.where("doc_id in (1, 2, 3, 5)").count() == 0
    names = ["lang_pred", "score", "n_lines", "n_deleted", "component_id", "copies", "copy", "shuffle_key", "bin", "id", "h", "node", "_name"]
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(k).cast("string") for k, c in enumerate(names)})
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, wide, "").columns == cp.COLUMNS
    assert cp.STAGES[-1][1](spark, wide, "").count() == len(rows)
    empty = df.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
