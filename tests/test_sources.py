import zipfile

import pytest
from pyspark.sql import functions as F

from kinfold.operators import aliases, numbering, quality, sampling
from kinfold.sources import layout, store, tsv


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tsv_keeps_empty_fields_quotes_and_words_like_null(spark, tmp_path):
    path = write(tmp_path / "a.tsv", ' entity_id \tbusiness_name\tcountry\tbusiness_address\textra\nS2-1\t"a" \\ b\tUS\t\tx\nS2-2\tnull\t IN\t  1 road\ty\n')
    got = {tuple(r) for r in tsv.read_source(spark, path).collect()}
    assert got == {("S2-1", '"a" \\ b', "", "US"), ("S2-2", "null", "  1 road", " IN")}
    again = str(tmp_path / "b")
    tsv.write_table(tsv.read_source(spark, path), again)
    assert {tuple(r) for r in tsv.read_source(spark, again).collect()} == got
    assert {r["id"] for r in tsv.read_ids(spark, again).collect()} == {"S2-1", "S2-2"}


def test_grouped_lists_keep_empty_ones_and_order(spark):
    refs = spark.createDataFrame([(0, "S1-b"), (1, "S1-a")], "s1 long, entity_id string")
    pairs = spark.createDataFrame([(0, 9, "S3-9"), (0, 2, "S2-2")], "s1 long, q long, q_id string")
    assert [tuple(r) for r in tsv.grouped_lists(refs, pairs).collect()] == [("S1-b", "S2-2,S3-9"), ("S1-a", "")]


def test_truth(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1, S3-2,,"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    assert {tuple(r) for r in sampling.explode_truth(lists).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}


HEAD = "source1_entity_id\tmatched_entity_ids\n"


def check(spark, tmp_path, text, required=("S1-1", "S1-2"), valid=None, candidate=None):
    path = write(tmp_path / "m.tsv", text)
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    return quality.validate(spark, path, ids(required), candidate and write(tmp_path / "c.tsv", candidate), ids(valid) if valid else None)


def test_a_right_file_passes(spark, tmp_path):
    assert check(spark, tmp_path, HEAD + "S1-1\tS2-1,S3-1\nS1-2\t\n").passed


@pytest.mark.parametrize(
    "text, rule",
    [
        ("source1_entity_id,matched_entity_ids\nS1-1,\n", "commas"),
        ("", "empty"),
        ("a\tb\n", "unexpected header"),
        (HEAD + "S1-1\tS2-1\nS1-1\t\nS1-2\t\n", "duplicate_row: S1-1"),
        (HEAD + "S1-1\tS2-1,S2-1\nS1-2\t\n", "repeated_id: S1-1"),
        (HEAD + "S1-1\tS1-2\nS1-2\t\n", "self_match: S1-2"),
        (HEAD + "S1-1\tX-2\nS1-2\t\n", "wrong_prefix: X-2"),
        (HEAD + "S1-1\t\n", "missing_s1: S1-2"),
        (HEAD + "S1-1\t\nS1-2\t\nS1-3\t\n", "extra_s1: S1-3"),
        (HEAD + "S1-1\t\nS1-2\nS1-2\t\n", "malformed_row: S1-2"),
    ],
)
def test_broken_rules(spark, tmp_path, text, rule):
    assert any(rule in e for e in check(spark, tmp_path, text).errors)


def test_unknown_ids_and_matches_outside_the_candidates(spark, tmp_path):
    text = HEAD + "S1-1\tS2-1,S2-7\nS1-2\t\n"
    report = check(spark, tmp_path, text, valid=["S2-1"], candidate="source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    assert any("unknown_id: S2-7" in e for e in report.errors) and report.warnings
    assert not quality.validate(spark, str(tmp_path / "none.tsv"), spark.createDataFrame([], "id string")).passed


def test_layout(spark, tmp_path):
    for f in tsv.SPLIT_FILES["test"].values():
        write(tmp_path / "deep" / "here" / f, "x")
    assert layout.find_split(spark, tmp_path, "test") == str(tmp_path / "deep" / "here")
    with pytest.raises(FileNotFoundError):
        layout.find_split(spark, tmp_path, "train")
    write(tmp_path / "work" / "aliases" / "name" / "part", "{}")
    write(tmp_path / "work" / "model" / "m", "1")
    assert layout.persist(spark, tmp_path / "work", tmp_path / "out", "model") == ["aliases", "model"]
    write(tmp_path / "new" / "aliases" / "name" / "part", "kept")
    assert [f for f in layout.restore(spark, tmp_path / "out", tmp_path / "new") if ".crc" not in f] == ["model/m"]
    assert (tmp_path / "new" / "aliases" / "name" / "part").read_text() == "kept"


def test_package(tmp_path):
    result = write(tmp_path / "out" / "test_source1.tsv", "x")
    for f in ("README.md", "requirements.txt", "kinfold/a.py", "kinfold/__pycache__/a.pyc", ".git/config.txt", "data/big.parquet"):
        write(tmp_path / "tree" / f, "y")
    with pytest.raises(FileNotFoundError, match="b.tsv, METHOD.md"):
        layout.package({"a.tsv": result, "b.tsv": tmp_path / "b"}, tmp_path / "tree", tmp_path / "tree" / "z.zip")
    write(tmp_path / "tree" / "METHOD.md", "y")
    layout.package({"a.tsv": result}, tmp_path / "tree", tmp_path / "tree" / "z.zip")
    assert sorted(zipfile.ZipFile(tmp_path / "tree" / "z.zip").namelist()) == ["output/a.tsv", "src/METHOD.md", "src/README.md", "src/kinfold/a.py", "src/requirements.txt"]


def test_rows_keep_the_order_of_their_file(spark, tmp_path):
    names = [f"S1-{i * 7919 % 30011:05d}" for i in range(30011)]
    path = write(tmp_path / "s1.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{n}\tx\ty\tUS\n" for n in names))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = numbering.numbered(tsv.read_source(spark, path, place=True), "s1", tsv.PLACE, store.written).select("s1", "entity_id")
        assert [r["entity_id"] for r in rows.orderBy("s1").collect()] == names
        pairs = spark.createDataFrame([], "s1 long, q long, q_id string")
        tsv.write_file(tsv.grouped_lists(rows, pairs), str(tmp_path / "m.tsv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert (tmp_path / "m.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\n" + "".join(f"{n}\t\n" for n in names)


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "50"}])
def test_numbers_of_many_rows(spark, conf):
    rows = spark.range(300_000).selectExpr("concat('S1-', lpad(id * 7919 % 300007, 6, '0')) as entity_id", "repeat('wide ', 20) as name", "id * 3 as more")
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = numbering.numbered(rows, "s1", ["entity_id"], store.written)
        n = got.selectExpr("count(*) as n", "count(distinct s1) as d", "min(s1) as low", "max(s1) as high", "count(distinct entity_id) as ids", "sum(more) as more").first()
        assert tuple(n) == (300_000, 300_000, 0, 299_999, 300_000, 3 * 300_000 * 299_999 // 2)
        order = [r["entity_id"] for r in got.orderBy("s1").select("entity_id").collect()]
        assert order == sorted(order)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_aliases(spark):
    pairs = spark.createDataFrame([(["delhi", "shop"], ["दिल्ली", "shop"])] * 2 + [(["dilli"], ["दिल्ली"]), (["a", "b"], ["दिल्ली"])], "ref_tokens array<string>, match_tokens array<string>")
    assert [tuple(r)[:3] for r in aliases.learn_name_aliases(pairs).collect()] == [("दिल्ली", "delhi", 2)]
    segs = spark.createDataFrame([("12 road, new delhi", "12 road, नई दिल्ली")] * 3, "ref_clean string, match_clean string")
    got = aliases.learn_segment_aliases(segs).collect()
    assert [(r["native"], r["latin"], r["n"], r["share"]) for r in got] == [("नई दिल्ली", "new delhi", 3, 1.0)]
    assert aliases.learn_name_aliases(pairs.limit(0)).count() == 0


def test_fold_of_the_parity(spark):
    rows = spark.range(100).select("id", sampling.query_fold("id", 2).alias("f"), sampling.query_fold(F.col("id") + (1 << 40), 5).alias("g")).collect()
    assert all(r["f"] == r["id"] * 2654435761 % 2**32 % 2 and r["g"] == (r["id"] + (1 << 40)) * 2654435761 % 2**32 % 5 for r in rows)
