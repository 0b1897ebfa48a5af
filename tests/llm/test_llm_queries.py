import pytest

from kinfold.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in QUERIES} and set(QUERIES) | {"pipeline"} <= names


def test_sharding_query(spark, sf_dir):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op10_consistent_ring"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts.items()}
    sizes = [sum(r["shard"] == s for r in got) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_url_query_has_a_row_for_each_page(spark, sf_dir):
    got = QUERIES["op7_url_templates"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r["page_id"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect())
    assert all(r["verdict"] in ("allow", "block") for r in got) and any(r["rule"] is None for r in got)
