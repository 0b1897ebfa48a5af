"""One document of each group stays, whatever its ids."""

import corpus_pipeline as cp


def test_repeated_and_null_ids(spark):
    text = lambda k, n=40: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(3, text("a")), (7, text("a") + " more"), (7, text("b"))]
    rows += [(1, text("c")), (1, text("c") + " more"), (5, text("c") + " other")]
    rows += [(None, text("d")), (9, text("d")), (None, text("e")), (None, text("e") + " more"), (None, text("f")), (None, text("f")), (8, text("g")), (8, text("g"))]
    rows += [(None, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in cp.one_of_each_group(spark, docs.repartition(3), "").collect()]
    group = lambda t: "null" if t is None else t[:1]
    assert {(d, group(t)) for d, t in got} == {(3, "a"), (7, "b"), (1, "c"), (9, "d"), (None, "e"), (None, "f"), (8, "g"), (None, ""), (None, "null")}
    assert len(got) == 9
