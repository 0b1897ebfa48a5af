import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold import views
from kinfold.operators import aliases


def plain(rows, min_count, min_share):
    """Every native segment with every latin one that its row lacks."""
    pairs, seen = Counter(), Counter()
    for ref, match in rows:
        m, s = ([" ".join(x.split()) for x in t.split(",")] for t in (match, ref))
        whole = f" {' '.join(m)} "
        absent = {x for x in s if x and not x.isdigit() and f" {x} " not in whole}
        for native in (x for x in m if any(c in views.NATIVE[1] for c in x)):
            seen[native] += 1
            pairs.update((native, x) for x in absent)
    out = {}
    for (native, latin), n in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        out.setdefault(native, (native, latin, n, round(n / seen[native], 9)))
    return {v for v in out.values() if v[2] >= min_count and v[3] >= min_share}


def rows_of(rng, n):
    pool = ["".join(rng.choice("aeioubcd") for _ in range(rng.randrange(1, 4))) for _ in range(25)] + ["", "12", "bcd d"]
    out = []
    for _ in range(n):
        ref = [" ".join(rng.choices(pool, k=rng.choice((1, 1, 2)))) for _ in range(rng.randrange(1, 8))]
        out += [(",".join(ref), ",".join(x.translate(str.maketrans(*views.NATIVE)) if i % 2 else x for i, x in enumerate(ref)))] * rng.choice((1, 1, 1, 3))
    return out


@pytest.mark.parametrize("min_count, min_share", [(3, 0.3), (1, 0.05), (2, 0.6)])
def test_segments_against_all_pairs(spark, min_count, min_share):
    rows = rows_of(random.Random(8), 120)
    found = aliases.learn_segment_aliases(spark.createDataFrame(rows, "ref_clean string, match_clean string"), min_count, min_share)
    assert {(r["native"], r["latin"], r["n"], round(r["share"], 9)) for r in found.collect()} == plain(rows, min_count, min_share) != set()


def test_long_rows_make_no_list_of_all_pairs(spark):
    """Three long rows with the same segments: their 4 million pairs of segments are one pair of classes."""
    ref = ",".join(f"a{i}b" for i in range(4000))
    df = spark.createDataFrame([(ref, ref)], "ref_clean string, x string").withColumn("i", F.explode(F.array(*map(F.lit, range(3))))).select(
        F.concat("ref_clean", F.lit(","), F.col("i").cast("string")).alias("ref_clean"),
        F.concat(F.translate("ref_clean", "a", "अ"), F.lit(","), F.col("i").cast("string")).alias("match_clean"),
    )
    found = aliases.learn_segment_aliases(df)
    assert [(r["latin"], r["n"], r["share"]) for r in found.collect()] == [("a0b", 3, 1.0)] * 4000
