import random

import numpy as np
import pytest

from kinfold.functions import similarity as s


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_against_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))) for _ in "ab")
        assert s.lcs_length(a, b) == lcs_by_table(a, b)


@pytest.mark.parametrize(
    "f, a, b, want",
    [
        (s.ratio, "abcd", "abed", 75.0),
        (s.ratio, "", "", 100.0),
        (s.ratio, "a", "", 0.0),
        (s.token_sort_ratio, "new york mets", "mets new york", 100.0),
        (s.token_set_ratio, "fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0),
        (s.token_set_ratio, "", "", 0.0),
        (s.partial_ratio, "this is a test", "this is a test!", 100.0),
        (s.partial_ratio, "", "", 100.0),
        (s.jaro_winkler, "martha", "marhta", 0.9611111),
        (s.jaro_winkler, "dixon", "dicksonx", 0.8133333),
        (s.jaro_winkler, "", "", 1.0),
        (s.jaro_winkler, "a", "", 0.0),
    ],
)
def test_known_values(f, a, b, want):
    assert f(a, b) == pytest.approx(want, abs=1e-6)


def test_token_set_without_shared_words_is_the_ratio_of_sorted_words():
    assert s.token_set_ratio("ab cd", "xb yd") == pytest.approx(s.ratio("ab cd", "xb yd"))


def test_columns_take_nulls(spark):
    df = spark.createDataFrame([("ab", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(s.col_ratio("a", "b")).collect()] == [0.0, 100.0]


def strings(rng, n, alphabet="abcd é"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 5, 12, 30, 63, 64, 65, 130, 140)))) for _ in range(n)]


@pytest.mark.parametrize("many, one", [(s.ratios, s.ratio), (s.token_sort_ratios, s.token_sort_ratio), (s.token_set_ratios, s.token_set_ratio), (s.partial_ratios, s.partial_ratio), (s.jaro_winklers, s.jaro_winkler)])
def test_batches_against_the_definitions(many, one):
    rng = random.Random(5)
    a, b = strings(rng, 200), strings(rng, 200)
    b[:40] = [x[::-1] for x in a[:40]]
    a[50:60] = ["x\0y", "\0", "", " ", "a a", "𝔘 a", "no such", "ab", "a", ""]
    got = many(a, b)
    assert got == pytest.approx([one(x, y) for x, y in zip(a, b, strict=True)])
    assert len(many([], [])) == 0


def test_lcs_of_batches_against_the_table():
    rng = random.Random(6)
    a, b = strings(rng, 120), strings(rng, 120)
    assert s.lcs_lengths(a, b).tolist() == [lcs_by_table(x, y) for x, y in zip(a, b, strict=True)]


def test_partial_of_equal_lengths_takes_the_better_direction():
    assert s.partial_ratio("aababb", "cacbbc") == s.partial_ratio("cacbbc", "aababb") == pytest.approx(66.66666, abs=1e-4)
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(6)) for _ in "ab")
        windows = lambda x, y: max(s.ratio(x, y[max(0, i) : i + 6]) for i in range(-5, 6))
        assert s.partial_ratio(a, b) == pytest.approx(max(windows(a, b), windows(b, a)))


def test_scores_of_texts_by_the_definitions():
    """Pairs of places, short texts (at most 64 characters) and longer ones."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab1\u00e9 ") for _ in range(rng.randrange(7)))
    short = ["", " ", "a", "aa", "b a", "a b", "a  b\t", "a" * 64, "a" * 33 + "b" * 31, "x\0", "\0", "ab ab"] + [" ".join(word() for _ in range(rng.randrange(6))) for _ in range(40)]
    for texts in (short, [*short[:20], "ab 1" * 17, "b1 a" * 40], [chr(0x4E00 + i) for i in range(30)]):
        i, j = (x.ravel() for x in np.meshgrid(*[np.arange(len(texts))] * 2))
        got = s.text_scores(texts, i, j)
        for name, f in (("ratio", s.ratio), ("tset", s.token_set_ratio), ("tsort", s.token_sort_ratio), ("partial", s.partial_ratio)):
            assert np.allclose(got[name], [f(texts[a], texts[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], atol=1e-9, rtol=0)
    assert all(len(x) == 0 for x in s.text_scores([], np.zeros(0, int), np.zeros(0, int)).values())
