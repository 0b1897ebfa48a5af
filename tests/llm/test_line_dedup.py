import random

import pytest

from kinfold.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, min_words):
    """Deletes each line of a run of min_words words or more, of any length, that occurs before, anywhere."""
    docs = []
    for d, t in sorted(rows):
        lines = t.split("\n") if t is not None else []
        docs.append((d, lines, [i for i, x in enumerate(lines) if x.split()]))
    seen, gone = set(), {d: set() for d, *_ in docs}
    for d, lines, used in docs:
        for k in range(len(used)):
            for n in range(1, len(used) - k + 1):
                run = tuple(lines[i] for i in used[k : k + n])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone[d].update(used[k : k + n])
                    seen.add(run)
    return {d: (len(lines), len(gone[d]), "\n".join(x for i, x in enumerate(lines) if i not in gone[d]) if lines else None) for d, lines, _ in docs}


@pytest.mark.parametrize("seed, min_words", [(1, 10), (2, 1), (3, 4), (4, 7)])
def test_against_brute_force(spark, seed, min_words):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 5, 12)))) for _ in range(14)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(30)]
    rows += [(100 + i, "\n".join([pool[0]] * 9)) for i in range(2)] + [(200, None), (201, "")]
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"]) for r in line_dedup(spark.createDataFrame(rows, SCHEMA), min_words=min_words).collect()}
    assert got == brute(rows, min_words)


def test_passage_of_many_words_stays_once(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(i, f"own line {i}\n{passage}\nlast of {i}") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(passage in t for t in got.values()) == 1 and passage in got[0]
    assert all(f"own line {i}" in t and f"last of {i}" in t for i, t in got.items())


def test_edges(spark):
    long_line = " ".join(["word"] * 5000)
    rows = [(None, long_line, 1), (1, long_line, 2), (1, long_line, 3), (2, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long")
    got = sorted((tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_deleted")) for r in line_dedup(df).collect()), key=str)
    assert got == sorted([(None, long_line, 1, 0), (1, "", 1, 1), (1, "", 1, 1), (2, None, 0, 0)], key=str)
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
