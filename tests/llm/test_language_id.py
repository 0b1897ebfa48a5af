import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import language_id as li
from kinfold.llm.queries import op5_language_id


def test_held_out_accuracy(spark):
    """Over the rows that nothing was learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op5_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 300 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98


def test_prediction_takes_nothing_but_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = li.fit_language_id(docs)
    one = {r["text"]: (r["lang_pred"], r["score"]) for r in li.identify(docs, model).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id")}).repartition(5)
    assert {r["text"]: (r["lang_pred"], r["score"]) for r in li.identify(other, model).collect()} == one


def test_hierarchy():
    rng = np.random.default_rng(1)
    centre = {"en": (1, 0, 1, 0), "de": (1, 0, 0, 1), "fr": (0, 1, 1, 0), "xx": (-1, -1, 0, 0)}
    langs = np.array([k for k in centre for _ in range(40)], object)
    x = np.stack([np.array(centre[k]) + rng.normal(0, 0.1, 4) for k in langs]).astype(np.float32)
    model = li._train(x, langs, 4, li.FAMILIES)
    assert model.families == ["germanic", "romance", "xx"] and model.languages["germanic"] == ["de", "en"] and model.pairs["romance"] == []
    names, scores = model.predict(x)
    assert names == list(langs) and (scores > 0.5).all()


def test_long_texts_in_pieces(monkeypatch):
    text = "Zwölf Boxkämpfer jagen 12 Eva quer über den Sylter Deich. " * 30
    whole = li.features(text, 512)
    monkeypatch.setattr(li, "_CHUNK", 100)
    assert np.allclose(li.features(text, 512), whole)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "a"), (2, "", None, "b"), (3, "123 !?", "en", "c"), (4, "x", "en", "d"), (4, "x", "en", "d"), (None, "word " * 100_000, None, "e")], "doc_id long, text string, lang string, score string")
    got = li.identify(docs, li.fit_language_id(docs)).collect()
    assert len(got) == 6
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "und", 2: "und", 3: "und", 4: "en", None: "en"}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    untaught = li.fit_language_id(docs.where("lang is null"))
    assert {r["lang_pred"] for r in li.identify(docs, untaught, keep_text=False).collect()} == {"und"}
    assert li.identify(docs.limit(0), untaught).count() == 0


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "\u00bd \u00b2 12", None), (2, "\u2460\u2167 _", None), (3, "\u00bd\u00e9", None), (4, "plain words", "en"), (5, "\u65e5\u672c", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify(docs, li.fit_language_id(docs)).collect()}
    assert got[1] == got[2] == ("und", 0.0) and {got[k][0] for k in (3, 4, 5)} == {"en"}


def test_the_sample_is_bounded_and_takes_no_text_twice(spark):
    docs = spark.range(30_000).selectExpr("'the same text' as text", "'en' as lang").unionByName(spark.range(500).selectExpr("concat('text ', id) as text", "case when id % 2 = 0 then 'en' else 'de' end as lang"))
    got = [tuple(r) for r in li.sample_rows(docs, "text", "lang", 50).collect()]
    assert len(got) == len(set(got)) == 100
    every = [tuple(r) for r in li.sample_rows(docs, "text", "lang", 10_000).collect()]
    assert len(every) == len(set(every)) == 501 and ("the same text", "en") in every


def plain_svm(x, y, c, steps=20_000):
    """The same squared hinge loss by gradient descent."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, rate = np.zeros(x.shape[1]), 1 / (1 + 2 * c * np.linalg.norm(x, 2) ** 2)
    for _ in range(steps):
        w -= rate * (w - 2 * c * (np.maximum(0, 1 - y * (x @ w)) * y) @ x)
    return w


def test_svm_against_gradient_descent():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + rng.normal(0, 0.3, 60) > 0.2, 1.0, -1.0)
    assert np.allclose(li.fit_svm(x, y, c=0.5, epochs=400), plain_svm(x, y, 0.5), atol=1e-3)


def test_prediction_against_plain_voting():
    rng = np.random.default_rng(5)
    langs = np.array([k for k in ("en", "de", "nl", "fr", "es", "xx") for _ in range(15)], object)
    x = rng.normal(0, 1, (len(langs), 8)).astype(np.float32)
    model = li._train(x, langs, 8, li.FAMILIES)
    new = rng.normal(0, 1, (50, 8)).astype(np.float32)
    names, scores = model.predict(new)
    for row, name, score in zip(np.hstack((new, np.ones((50, 1)))).astype(float), names, scores, strict=True):
        margins = [float(row @ w) for w in model.family_weights]
        family = model.families[margins.index(max(margins))]
        one, two = sorted(margins)[-1], sorted(margins)[-2]
        votes = {i: [0, 0.0, float("inf")] for i in range(len(model.languages[family]))}
        for i, j, w in model.pairs[family]:
            d = float(row @ w)
            for k, v in ((i, d), (j, -d)):
                votes[k] = [votes[k][0] + (v > 0), votes[k][1] + v, min(votes[k][2], v)]
        best = max(votes, key=lambda k: (votes[k][0], votes[k][1], -k))
        assert name == model.languages[family][best]
        margin = min((one - two) / 2, votes[best][2])
        assert abs(score - 1 / (1 + np.exp(-model.slope * max(-50, min(50, margin))))) < 1e-5
