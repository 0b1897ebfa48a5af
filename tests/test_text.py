import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as tx


def dictionary(spark, values):
    return spark.createDataFrame(list(values.items()), "native string, latin string")


def names(spark, raws, aliases=None):
    df = spark.createDataFrame([(i, r, "", "US") for i, r in enumerate(raws)], "entity_id int, name string, address string, country string")
    return {r["name"]: r for r in tx.normalise(df, aliases and dictionary(spark, aliases)).collect()}


def addresses(spark, raws, aliases=None, segments=None):
    df = spark.createDataFrame([(i, "", r, " US ") for i, r in enumerate(raws)], "entity_id int, name string, address string, country string")
    return {r["address"]: r for r in tx.normalise(df, aliases and dictionary(spark, aliases), segments and dictionary(spark, segments)).collect()}


def test_names(spark):
    got = names(spark, ["Moncada L.L.C.", "L.L.C.", "प्राइवेट", "Straße & Söhne", "shop.com", "com shop", "G00gle 50", None, "", "!!!"])
    assert (got["Moncada L.L.C."]["name_clean"], got["Moncada L.L.C."]["name_key"]) == ("moncada llc", "moncada")
    assert got["L.L.C."]["name_key"] == "iic"
    assert got["प्राइवेट"]["name_clean"] == "प्राइवेट" and got["प्राइवेट"]["name_native"]
    assert got["Straße & Söhne"]["name_clean"] == "strasse and sohne"
    assert got["shop.com"]["name_key"] == "shop" and got["com shop"]["name_key"] == "com shop"
    assert got["G00gle 50"]["name_key"] == "googie 50"
    assert got[None]["name_key"] == got[""]["name_key"] == got["!!!"]["name_key"] == ""


def test_aliases_may_hold_several_words(spark):
    got = names(spark, ["दिल्ली shop"], {"दिल्ली": "new delhi"})
    assert got["दिल्ली shop"]["name_clean"] == "new delhi shop"


@pytest.mark.parametrize(
    "raw, clean, nums",
    [
        ("1795 Westchester Drive, High Point, NC", "1795 westchester dr high point nc", [1795]),
        ("no15venkatesh", "15 venkatesh", [15]),
        ("0071", "71", [71]),
        ("12 Main Street, New York, New Delhi", "12 main st ny new dl", [12]),
        ("Springfieldtownship Jammu and Kashmir", "springfield jk", []),
        ("5 5 7 Texas", "5 5 7 tx", [5, 7]),
        ("१२ road", "12 rd", [12]),
        (None, "", []),
    ],
)
def test_addresses(spark, raw, clean, nums):
    row = addresses(spark, [raw])[raw]
    assert (row["addr_clean"], row["nums"], row["country"]) == (clean, nums, "us")
    assert row["addr_empty"] == (clean == "")


def test_long_numbers_keep_their_last_digits(spark):
    assert addresses(spark, ["1" * 25])["1" * 25]["nums"] == [int("1" * 18)]


def test_segments(spark):
    got = addresses(spark, ["12 road, नई दिल्ली"], segments={"नई दिल्ली": "new delhi"})
    assert got["12 road, नई दिल्ली"]["addr_clean"] == "12 rd new dl"


def test_initials(spark):
    got = spark.createDataFrame([("l l c",), ("a bc d e",), ("x",), ("1 a b",)], "s string").select("s", tx.join_initials("s").alias("j")).collect()
    assert {r["s"]: r["j"] for r in got} == {"l l c": "llc", "a bc d e": "a bc de", "x": "x", "1 a b": "1 ab"}
    assert spark.range(1).select(tx.is_non_latin(F.lit("ñ"))).first()[0] is False
