import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as tx
from kinfold.sources import store

ROWS = [(1, ["नई", "oak", "नई", " ऊन "]), (2, ["oak", "elm"]), (3, []), (4, None), (5, ["ऊन", None, "é"]), (6, ["अ"])]
KNOWN = [("नई", "new"), ("नई", "nova"), ("ऊन", "wool road"), ("oak", "elm"), (None, "none")]
WORDS = {1: ["new", "elm", "new", " ऊन "], 2: ["oak", "elm"], 3: [], 4: None, 5: ["wool road", None, "é"], 6: ["अ"]}
TRIMMED = WORDS | {1: ["new", "elm", "new", "wool road"]}


def tables(spark):
    return spark.createDataFrame(ROWS, "entity_id long, words array<string>"), spark.createDataFrame(KNOWN, "native string, latin string")


@pytest.mark.parametrize("held", [200_000, 0])
@pytest.mark.parametrize("form, want", [(None, WORDS), (lambda x: F.trim(x), TRIMMED)])
def test_words_by_a_held_and_by_a_joined_dictionary(spark, monkeypatch, held, form, want):
    monkeypatch.setattr(tx, "HELD_ROWS", held)
    records, known = tables(spark)
    found = tx.looked_up(records, "words", "entity_id", known, form)
    assert found.columns == records.columns and {r["entity_id"]: r["words"] for r in found.collect()} == want
    assert {r["entity_id"]: r["words"] for r in tx.looked_up(records, "words", "entity_id", known.limit(0), form).collect()} == dict(ROWS)


def test_a_held_dictionary_shuffles_no_words(spark):
    records, known = tables(spark)
    plan = tx.looked_up(records, "words", "entity_id", known)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_a_joined_dictionary_shuffles_a_row_s_words_once(spark, monkeypatch):
    """Of a row of 3,000 words, three of them distinct, three are joined."""
    monkeypatch.setattr(tx, "HELD_ROWS", 0)
    records = spark.createDataFrame([(1, ["नई", "oak", "ऊन"] * 1000)], "entity_id long, words array<string>")
    found = tx.looked_up(records, ["words"], "entity_id", tables(spark)[1])
    assert found.first()["words"] == ["new", "elm", "wool road"] * 1000
    assert "array_distinct" in found._jdf.queryExecution().executedPlan().toString()


def test_tables_on_the_way_go(spark):
    made = []

    def make():
        made.append(store.written(spark.range(3), "first"))
        return made[0].where("id > 0")

    assert sorted(r["id"] for r in store.settled(make, "last").collect()) == [1, 2]
    assert not any(store.exists(spark, p) for p in made[0].inputFiles())


@pytest.mark.parametrize("held", [200_000, 0])
def test_several_columns_at_once(spark, monkeypatch, held):
    monkeypatch.setattr(tx, "HELD_ROWS", held)
    records, known = tables(spark)
    two = records.join(records.select((7 - F.col("entity_id")).alias("entity_id"), F.col("words").alias("more")), "entity_id")
    found = {r["entity_id"]: (r["words"], r["more"]) for r in tx.looked_up(two, ["words", "more"], "entity_id", known).collect()}
    assert found == {i: (WORDS[i], WORDS[7 - i]) for i in WORDS}
