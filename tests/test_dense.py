import math
import random

import pytest

from kinfold.operators.dense import nearest_of_label

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, k):
    """The k nearest by sums in the order of the components; null cosines last."""
    out = set()
    for i, a, x in rows:
        found = []
        for j, b, y in rows:
            if a is not None and a == b and i != j:
                if x is None or y is None or len(x) != len(y) or None in x + y:
                    found.append((1, 0.0, j, None))
                else:
                    dot = lambda u, v: sum(p * q for p, q in zip(u, v, strict=True))
                    c = round(dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))), 6)
                    found.append((0, -c, j, c))
        out |= {(i, j, c, r + 1) for r, (_, _, j, c) in enumerate(sorted(found, key=lambda f: f[:3])[:k])}
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_against_all_pairs(spark, block):
    rng = random.Random(4)
    pool = [[float(rng.randrange(-3, 4)) + 0.5 for _ in range(5)] for _ in range(12)]
    rows = [(i, rng.choice([1, 2, None]), rng.choice(pool)) for i in range(90)]
    rows += [(100, 1, None), (101, 1, [1.0, None, 2.0, 0.5, 1.0]), (102, 1, [1.0, 2.0]), (103, 3, [1.0] * 5), (104, 3, None), (105, 4, [1.0] * 5)]
    got = {tuple(r[c] for c in ("vec_id", "near_id", "cosine", "rank")) for r in nearest_of_label(spark.createDataFrame(rows, SCHEMA), 3, block).collect()}
    assert got == plain(rows, 3)


def test_no_list_of_all_pairs(spark):
    """Pairs meet within a block: no operator of the plan compares two ids."""
    df = nearest_of_label(spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in range(50)], SCHEMA), 3)
    assert df.count() == 150 and "<=> near_id" not in df._jdf.queryExecution().toString() and "MapInPandas" in df._jdf.queryExecution().toString()
