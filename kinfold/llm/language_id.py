"""Language identification by hierarchical discrimination.

First the language family is predicted (linear support vector machines, one against the rest), then
linear support vector machines, one for each pair of languages, separate the languages of that family.
Features are hashed byte 2- and 3-grams of the whole lower-cased text, with ASCII non-letters as
spaces, square-rooted and scaled to length 1.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: Families of languages by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}
_WORDLIKE = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 18
_SPACED = np.arange(256, dtype=np.uint32)
_SPACED[[x for x in range(128) if not chr(x).isalpha()]] = 32


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter (Unicode category L); fractions and other numerals are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text or ""))


def features(text: str | None, dims: int) -> np.ndarray | None:
    """The feature vector of a whole text, or None if the text is null or has no letter."""
    if not has_letter(text):
        return None
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(dims, np.float64)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for at in range(0, len(raw), _CHUNK):
        piece = _SPACED[raw[max(0, at - 2) : at + _CHUNK]]
        two = piece[:-1] * np.uint32(2654435761) + piece[1:] * np.uint32(40503)
        three = two[:-1] * np.uint32(31) + piece[2:] * np.uint32(2246822519)
        fresh = 1 if at else 0  # the pair that the overlap shares with the chunk before
        for x in (two[fresh:], three):
            counts += np.bincount((x * np.uint32(2654435769)) >> shift, minlength=dims)
    out = np.sqrt(counts).astype(np.float32)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the bias last) of a linear SVM with squared hinge loss, by dual coordinate descent. y: 1 or -1."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    w, alpha, diagonal = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x) + 0.5 / c
    order, rng = np.arange(len(x)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            now = max(0.0, alpha[i] - gradient / diagonal[i])
            if now != alpha[i]:
                w += (now - alpha[i]) * y[i] * x[i]
                alpha[i] = now
    return w


@dataclass
class LanguageModel:
    dims: int
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)
    #: Steepness of the score as a function of the margin.
    slope: float = 4.0

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of rows of feature vectors."""
        if not self.families:
            return ["und"] * len(x), np.zeros(len(x))
        # doubles and rounding: a row's answer doesn't depend on the rows it comes with
        x = np.hstack((x, np.ones((len(x), 1)))).astype(np.float64)
        if len(self.families) > 1:
            margins = x @ self.family_weights.T
            family = margins.argmax(1)
            two = np.partition(margins, -2, axis=1)
            margin = (two[:, -1] - two[:, -2]) / 2
        else:
            family, margin = np.zeros(len(x), int), np.full(len(x), np.inf)
        names = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            mine = np.flatnonzero(family == f)
            own = self.languages[name]
            votes, sums = np.zeros((len(mine), len(own))), np.zeros((len(mine), len(own)))
            least = np.full((len(mine), len(own)), np.inf)
            for i, j, w in self.pairs[name]:
                d = x[mine] @ w
                for k, v in ((i, d), (j, -d)):
                    votes[:, k] += v > 0
                    sums[:, k] += v
                    least[:, k] = np.minimum(least[:, k], v)
            best = np.array([max(range(len(own)), key=lambda k: (votes[r, k], sums[r, k], -k)) for r in range(len(mine))], int)
            names[mine] = [own[k] for k in best]
            margin[mine] = np.minimum(margin[mine], least[np.arange(len(mine)), best])
        return list(names), np.round(1 / (1 + np.exp(-self.slope * np.clip(margin, -50, 50))), 6)


def _train(x: np.ndarray, langs: np.ndarray, dims: int, families: dict[str, str]) -> LanguageModel:
    model = LanguageModel(dims)
    family = np.array([families.get(x, x) for x in langs])
    model.families = sorted(set(family))
    if len(model.families) > 1:
        model.family_weights = np.stack([fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in model.families])
    for f in model.families:
        own = model.languages[f] = sorted(set(langs[family == f]))
        model.pairs[f] = []
        for i, j in itertools.combinations(range(len(own)), 2):
            rows = (langs == own[i]) | (langs == own[j])
            model.pairs[f].append((i, j, fit_svm(x[rows], np.where(langs[rows] == own[i], 1.0, -1.0))))
    return model


def sample_rows(labelled: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(text, lang): for each language the ``most`` distinct texts with the smallest hashes, one row each.

    Only hashes are shuffled, and of a language with many texts only those below a bound that about 4 * ``most``
    texts are below come to its task.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    place = F.pmod("h", F.lit(1 << 48))
    hashes = common.cut(hashed.select("lang", "h").distinct(), "hashes")
    counts = common.cut(hashes.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    low = hashes.join(common.maybe_broadcast(counts, counts.count()), "lang").where(place * (F.col("n") / (4.0 * most)) < float(1 << 48))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(place, "h"))
    chosen = common.cut(low.withColumn("r", rank).where(F.col("r") <= most).select("lang", "h"), "chosen")
    return hashed.join(common.maybe_broadcast(chosen, chosen.count()), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("text", "lang")


def fit_language_id(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 600, dims: int = 4096, families: dict[str, str] = FAMILIES
) -> LanguageModel:
    """Fits on at most ``sample_per_language`` distinct texts of each language, those with the smallest hashes (a documented bound).

    Rows with a null text or language, and texts without letters, are not learned from; a text under several
    languages is learned for each. Repeated rows count once. Only feature vectors of the sample come to
    the driver. Without any row the model answers ``und``. Other columns are not read.
    """
    chosen = sample_rows(labelled, text_col, lang_col, sample_per_language)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                if (x := features(text.as_py(), dims)) is not None:
                    langs.append(lang.as_py())
                    out.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "x"])

    got = sorted((r["lang"], bytes(r["x"])) for r in chosen.mapInArrow(vectors, "lang string, x binary").collect())
    if not got:
        return LanguageModel(dims)
    x = np.stack([np.frombuffer(v, np.float16) for _, v in got]).astype(np.float32)
    return _train(x, np.array([k for k, _ in got], object), dims, families)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to ``docs``, replacing columns of these names; without the text unless ``keep_text``.

    A null or empty text, or one without a letter: ``und``, score 0. Equal texts get equal answers; an
    empty table gives an empty result. Very long texts are read in pieces, whole. Other columns are kept.
    """
    rest = docs.drop("lang_pred", "score")
    kept = [i for i, c in enumerate(rest.columns) if keep_text or c != text_col]
    schema = rest.select([rest.columns[i] for i in kept]).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    at_text = rest.columns.index(text_col)
    dims = model.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = [features(t.as_py(), dims) for t in part.column(at_text)]
                known = [i for i, v in enumerate(x) if v is not None]
                names, scores = np.full(len(x), "und", object), np.zeros(len(x))
                if known:
                    names[known], scores[known] = model.predict(np.stack([x[i] for i in known]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(part.schema.names[i] for i in kept), "lang_pred", "score"]
                )

    return rest.mapInArrow(run, schema)
