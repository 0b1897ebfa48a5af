import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import ngram_join as m
from kinfold.llm.common import components
from kinfold.llm.ngram_join import ngram_jaccard_join

SCHEMA = "doc_id long, text string"


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, size=5):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {(d, len(sets[d]), root(d)) for d in ids}


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 60, 90)))] for _ in range(8)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            w = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.7:
            w = passage + [rng.choice(vocabulary) for _ in range(rng.randrange(14))]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(50))]
        rows.append((i * 7 % 1009, "  ".join(w).title() if rng.random() < 0.2 else "\n".join(w)))
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"leader_rounds": 0, "block": 5}), (3, {"leader_rounds": 3, "fragments": 3, "share": 0.1}), (4, {"share": 1 - 2**-20})])
def test_against_brute_force(spark, seed, options):
    rows = corpus(seed)
    got = {tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c d e"), (7, "a b c d e"), (8, "é b c d e")]
    got = {tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8)}
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "x"), (5, text, "y"), (None, text, "z"), (9, text + " more", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted((tuple(r) for r in ngram_jaccard_join(df).collect()), key=str) == sorted([(5, 26, 5), (5, 26, 5), (None, 26, 5), (9, 27, 5)], key=str)


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 40))) for _ in range(500)) + " " + "x" * 3000
    whole = m.word_hashes(text)
    monkeypatch.setattr(m, "_CHUNK", 64)
    assert np.array_equal(m.word_hashes(text), whole)
    assert len(whole) == len(words_of(text)) and len(set(whole.tolist())) == len(set(words_of(text)))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame([(x,) for x in label], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == label


def test_words_that_a_polynomial_modulo_a_power_of_two_confuses(spark):
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    assert len(set(m.word_hashes(f"{thue} {other}").tolist())) == 2
    got = {tuple(r) for r in ngram_jaccard_join(spark.createDataFrame([(1, thue), (2, other)], SCHEMA)).collect()}
    assert got == {(1, 1, 1), (2, 1, 2)}


def test_sets_whose_names_clash(spark, monkeypatch):
    real = m._digest
    monkeypatch.setattr(m, "_digest", lambda s: (real(s)[0] % 3, real(s)[1]))
    rows = corpus(6)
    got = {tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def alike(n):
    """Texts of a common passage and four pieces, each shared with three others, but no two with one other: alike, and none link."""
    passage, piece = " ".join(f"p{i}" for i in range(120)), [" ".join(f"r{k}x{i}" for i in range(8)) for k in range(n)]
    return [(i, " ".join(piece[(i + k) % n] for k in (0, 1, 4, 6)) + " " + passage) for i in range(n)]


def test_many_sets_that_are_alike_but_not_linked(spark):
    rows = alike(40)
    got = {tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len({c for _, _, c in got}) == 40
    rows = alike(20_000)
    counted, real = [], m._pairs_of_lists
    try:
        m._pairs_of_lists = lambda *a: counted.append(real(*a)) or counted[-1]
        got = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(4)).agg(F.count_distinct("component_id")).first()[0]
    finally:
        m._pairs_of_lists = real
    assert got == 20_000
    assert sum(c.count() for c in counted) <= 8 * 20_000  # of the pieces; the passage makes none
