import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import retrieval
from kinfold.plans import model
from kinfold.queries import QUERIES
from kinfold.sources import store

WORDS = ["oak", "elm", "pine", "birch", "larch", "yew", "road", "st", "42", "no7"]


def records(spark, rows, key):
    out = spark.createDataFrame(rows, f"{key} long, country string, name_key string, addr_clean string")
    return out.withColumn("addr_empty", F.col("addr_clean") == "")


@pytest.mark.parametrize("w_name, k, block, ref_block", [(0.5, (3, 3, 8), 32768, 65536), (0.3, (2, 1, 2), 7, 11), (1.0, (1, 4, 3), 64, 5)])
def test_exact_blocks_keep_the_candidates_of_all_pairs(spark, w_name, k, block, ref_block):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.sample(WORDS, rng.randrange(n + 1)))
    ref = records(spark, [(i * 7 % 150, rng.choice("ab"), text(2), text(3)) for i in range(150)], "s1")
    queries = records(spark, [(i, rng.choice("abz"), text(2), text(3)) for i in range(90)], "q")
    plain = lambda pairs: sorted((r["q"], r["s1"], *(round(r[c], 6) for c in ("sn", "sa", "w_name", "comb", "q_comb1", "q_comb2", "q_sn1", "q_sa1"))) for r in retrieval.candidates(pairs, *k).collect())
    want = plain(retrieval.score_pairs(ref, queries, w_name))
    assert want and plain(retrieval.retrieve_exact(ref, queries, w_name, *k, block=block, ref_block=ref_block)) == want


def test_exact_blocks_leave_no_list_of_all_pairs(spark):
    """Two thousand pairs of each query share a gram, a few of them leave the blocks."""
    ref = records(spark, [(i, "a", f"oak {i % 3}", f"pine {i}") for i in range(2000)], "s1")
    queries = records(spark, [(i, "a", f"oak {i % 2}", f"pine {i}") for i in range(50)], "q")
    assert 50 * 8 <= retrieval.retrieve_exact(ref, queries).count() <= 50 * 14


def test_exact_blocks_of_empty_tables_and_texts(spark):
    ref = records(spark, [(1, "a", "oak", "pine")], "s1")
    queries = records(spark, [(1, "a", "", ""), (2, "z", "oak", "pine"), (3, "a", "oak", "")], "q")
    assert [(r["q"], r["s1"], round(r["comb"], 6)) for r in retrieval.retrieve_exact(ref, queries).collect()] == [(3, 1, 1.0)]
    assert retrieval.retrieve_exact(ref.where("false"), queries).count() == 0
    assert retrieval.retrieve_exact(ref, queries.where("false")).count() == 0


@pytest.mark.parametrize("name", ["pair_features", "sketch_recall"])
def test_query_lists_no_pairs_of_a_shared_gram(spark, sf_dir, monkeypatch, name):
    def listed(*_, **__):
        raise AssertionError("all pairs that share a gram")

    monkeypatch.setattr(retrieval, "score_pairs", listed)
    assert QUERIES[f"q_{name}"](spark, sf_dir).count() > 0


def test_sketched_blocks_leave_each_query_its_best_once(spark):
    """Many blocks of references: a query's rows are the best of all blocks, and those of the exact path where sketches have room."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.sample(WORDS, rng.randrange(n + 1)))
    ref = records(spark, [(i * 7 % 300, rng.choice("ab"), text(2), text(3)) for i in range(300)], "s1")
    queries = records(spark, [(i, rng.choice("abz"), text(2), text(3)) for i in range(120)], "q")
    found = retrieval.retrieve_sketched(ref, queries, dim=1 << 16, block=50, ref_block=20).collect()
    of = [r["q"] for r in found]
    assert len({(r["q"], r["s1"]) for r in found}) == len(found) and max(map(of.count, set(of))) <= 14
    plain = lambda df: sorted((r["q"], r["s1"], *(round(r[c], 6) for c in ("sn", "sa", "w_name", "comb", "q_comb1", "q_comb2", "q_sn1", "q_sa1"))) for r in df.collect())
    want = plain(retrieval.candidates(retrieval.score_pairs(ref, queries)))
    for few in (False, True):
        assert plain(retrieval.candidates(retrieval.retrieve_sketched(ref, queries, dim=1 << 16, block=50, ref_block=20), few=few)) == want


def test_sketched_candidates_are_made_once(spark, sf_dir):
    plan = QUERIES["q_topk_sketched"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_best_of_sketches_by_plain_sorting():
    rng = np.random.default_rng(3)
    for n, k in ((5, 8), (200, 8), (3000, 24)):
        score = np.where(rng.random((40, n)) < 0.6, 0, rng.integers(0, 400, (40, n)) / 400).astype(np.float32)
        score[0], score[1, 2:] = 0, 0
        want = {(i, j) for i in range(40) for j in sorted(range(n), key=lambda j: (-round(float(score[i, j]), 5), j))[:k]}  # noqa: B023
        i, j = retrieval._top(score.copy(), k)
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def block(rng, name, ids, names, addresses):
    """A block of records as ``_blocked`` makes it, its texts made of two-letter grams."""
    out = {f"{name}_id": np.arange(ids)}
    for c, most in (("n", names), ("a", addresses)):
        texts = sorted({" ".join(sorted(rng.sample(WORDS, rng.randrange(4)))) + (f" {i}" if i % 5 else "") for i in range(most)})
        of = [texts[i] if i < len(texts) else rng.choice(texts) for i in range(ids)]
        rng.shuffle(of)
        grams = [[hash_of(t[i : i + 2]) for i in range(len(t) - 1)] for t in texts]
        grams = [sorted(set(g)) for g in grams]
        weights = [[len(g) ** -0.5] * len(g) for g in grams if g]
        out |= {f"{name}_{c}_of": of, f"{name}_{c}_text": texts, f"{name}_{c}_size": [len(g) for g in grams], f"{name}_{c}_g": sum(grams, []), f"{name}_{c}_w": sum(weights, [])}
    return out


def hash_of(gram):
    return (ord(gram[0]) * 1_000_003 + ord(gram[1]) * 7919) * 2_654_435_761 % 2**63


@pytest.mark.parametrize("refs, names, addresses, k", [(3000, 20, 2500, (3, 3, 8)), (3000, 30, 200, (3, 3, 8)), (1100, 5, 1100, (1, 2, 4))])
def test_references_of_shared_names_are_found_as_others_are(monkeypatch, refs, names, addresses, k):
    """Names that many references have are compared once for the block; the best are the same."""
    rng = random.Random(refs + names)
    row = block(rng, "qs", 150, 25, 140) | block(rng, "ss", refs, names, addresses)
    row["qs_w_name"] = [rng.choice((0.0, 0.3, 0.5, 1.0)) for _ in range(150)]
    found = {}
    for shared in (True, False):
        sides = {c: retrieval._Side(row, f"qs_{c}") for c in "na"}
        theirs = {c: retrieval._Side(row, f"ss_{c}") for c in "na"}
        assert retrieval._Shared.fits(sides, theirs, 8 * max(k))
        with monkeypatch.context() as patch:
            if not shared:
                patch.setattr(retrieval._Shared, "fits", staticmethod(lambda *_: False))
            i, s1, *rest = retrieval._sketch_search(row, retrieval._Asked(row, sides["n"], sides["a"]), sides, 256, 8, k)
        found[shared] = {(q, s): tuple(x) for q, s, *x in zip(i.tolist(), s1.tolist(), *(x.tolist() for x in rest), strict=True)}
        assert len(found[shared]) == len(i)
    assert len(found[True]) >= 140 * k[2] and found[True].keys() == found[False].keys()
    for pair, (sn, sa, comb, address) in found[True].items():
        assert np.allclose((sn, sa, comb), found[False][pair][:3], atol=2e-6) and address == found[False][pair][3]


def test_address_scores_are_made_by_the_search(spark, sf_dir, monkeypatch):
    """No join of records to the candidates and no pass for each score: they come with the pairs."""
    plans = {}

    def written(df, table, **_):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(store, "written", written)
    out = QUERIES["q_address_scores"](spark, sf_dir)
    after = plans["candidates"].split("MapInPandas")[0]
    assert out.columns == ["q", "s1", "ad_ratio", "ad_tset", "ad_tsort", "ad_partial"]
    assert not any(x in after for x in ("Join", "Window", "ArrowEvalPython", "Exchange"))


@pytest.mark.parametrize("name", ["address_scores", "gbt_score"])
def test_query_looks_up_its_candidates_once(spark, sf_dir, monkeypatch, name):
    """The search runs once, not for each channel."""
    plans = {}

    class Enough(Exception):
        pass

    def written(df, table, **_):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        if table == "candidates":
            raise Enough
        return df

    monkeypatch.setattr(store, "written", written)
    with pytest.raises(Enough):
        QUERIES[f"q_{name}"](spark, sf_dir)
    assert plans["candidates"].count("MapInPandas") == 1


def test_boosting_begins_without_the_tables_of_the_retrieval(spark, sf_dir, monkeypatch):
    made = []
    write = store.written

    class Enough(Exception):
        pass

    def written(df, table, **more):
        out = write(df, table, **more)
        made.append((table, out.inputFiles()[0].rsplit("/", 1)[0]))
        return out

    def stop(*_):
        raise Enough

    monkeypatch.setattr(store, "written", written)
    monkeypatch.setattr(model, "fit", stop)
    with pytest.raises(Enough):
        QUERIES["q_gbt_score"](spark, sf_dir)
    assert [table for table, path in made if store.exists(spark, path)] == ["labelled"] and len(made) > 2
