"""Texts that only null ids have take part in links."""

from kinfold.llm.ngram_join import ngram_jaccard_join


def test_null_id_near_copy_between_two_documents(spark):
    words = [f"w{i}" for i in range(114)]
    rows = [(1, " ".join(words[:100])), (None, " ".join(words)), (2, " ".join(words[14:]))]
    alone = [f"v{i}" for i in range(60)]
    rows += [(None, " ".join(alone)), (None, " ".join(alone) + " more"), (None, "one of its own with some words")]
    rows += [(None, "one " * k) for k in range(5, 25)]
    got = [tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(got) == len(rows)
    assert sorted((r for r in got if r[2] is not None), key=str) == [(1, 96, 1), (2, 96, 1), (None, 110, 1)]


def test_one_id_over_several_texts(spark):
    texts = [" ".join(f"{k}w{i}" for i in range(40)) for k in range(4)]
    rows = [(7, t) for t in texts] + [(10 + k, t + " more") for k, t in enumerate(texts)]
    got = {tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 36, 7)} | {(10 + k, 37, 7) for k in range(4)}
