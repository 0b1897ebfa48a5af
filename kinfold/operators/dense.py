"""Nearest dense vectors of the same label, by cosine: blocks of vectors against each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_NEAR = 2e-6  # cosines this close can change places when they are rounded to 6 digits
_OWN = -9.0  # in the order of cosines: pairs of one id


class _Block:
    """ids and, by their lengths, the vectors of a block with their norms. Nulls have length -1."""

    def __init__(self, ids, sizes, flat):
        self.ids, sizes = np.asarray(ids), np.asarray(sizes, np.int64)
        flat, ends = np.asarray(flat, np.float64), np.cumsum(np.maximum(sizes, 0))
        self.by_size = {}
        for z in np.unique(sizes[sizes >= 0]).tolist():
            at = np.flatnonzero(sizes == z)
            x = flat[(ends[at] - z)[:, None] + np.arange(z)]
            self.by_size[z] = at, x, np.sqrt(_dot(x, x))
        self.places = {z: at for z, (at, _, _) in self.by_size.items()}

    def first_copies(self, k: int) -> None:
        """Leaves the k smallest ids of equal vectors, as others can't be among the k - 1 nearest; ids are sorted."""
        if len(np.unique(self.ids)) < len(self.ids):
            return
        for z, (at, x, norm) in self.by_size.items():
            same = pd.Series(list(map(bytes, np.ascontiguousarray(x)))) if z else pd.Series([b""] * len(at))
            kept = (same.groupby(same).cumcount() < k).to_numpy()
            self.by_size[z] = at[kept], x[kept], norm[kept]


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components as SQL does."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _nearest(a: _Block, b: _Block, k: int, step: int = 256) -> Iterator[pd.DataFrame]:
    """The k nearest of b for each vector of a; NaN first, pairs without a cosine (nulls, other lengths) last. Ties to the smaller id."""
    parts = [(z, at[s : s + step], x[s : s + step], norm[s : s + step]) for z, (at, x, norm) in a.by_size.items() for s in range(0, len(at), step)]
    nulls = np.setdiff1d(np.arange(len(a.ids)), np.concatenate([np.zeros(0, np.int64), *a.places.values()]))
    parts += [(-1, nulls[s : s + step], None, None) for s in range(0, len(nulls), step)]
    for z, at, x, norm in parts:
        i, j, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        others = np.arange(len(b.ids))
        with np.errstate(all="ignore"):
            if z in b.by_size:
                cols, y, y_norm = b.by_size[z]
                others = np.setdiff1d(others, b.places[z])
                near = (x @ y.T) / (norm[:, None] * y_norm)
                near[np.isnan(near)] = np.inf
                near[a.ids[at][:, None] == b.ids[cols]] = _OWN
                last = np.partition(near, -k, axis=1)[:, -k, None] if len(cols) > k else _OWN
                i, j = np.nonzero((near >= last - _NEAR) & (near > _OWN))
                exact = [_dot(x[p], y[q]) / (norm[p] * y_norm[q]) for s in range(0, len(i), 65536) for p, q in ((i[s : s + 65536], j[s : s + 65536]),)]
                cosine = np.round(np.concatenate([cosine, *exact]), 6)
                j = cols[j]
        # the smallest ids stand for all pairs without a cosine
        others = others[np.isin(b.ids[others], np.unique(b.ids[others])[: k + 1])]
        kind = np.concatenate([np.where(np.isnan(cosine), 2, 0), np.ones(len(at) * len(others), np.int64)])
        i, j = np.concatenate([i, np.repeat(np.arange(len(at)), len(others))]), np.concatenate([j, np.tile(others, len(at))])
        cosine = np.where(kind == 0, np.concatenate([cosine, np.zeros(len(j) - len(cosine))]), 0)
        order = np.lexsort((b.ids[j], -cosine, np.array([1, 2, 0])[kind], i))
        order = order[a.ids[at][i[order]] != b.ids[j[order]]]
        i, j, cosine, kind = i[order], j[order], cosine[order], kind[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        yield pd.DataFrame({"vec_id": a.ids[at][i], "near_id": b.ids[j], "cosine": cosine, "kind": kind})[rank < k]


def nearest_of_label(vectors: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(vec_id, near_id, cosine, rank): the k nearest vectors of the same label; ties to the smaller id. vectors: (vec_id, label, embedding).

    Blocks of a label meet each other by an equi-join; a matrix product finds the pairs that can be among the k best,
    and only these get their cosine as the sum in the order of the components, to 6 places.
    """
    rows = vectors.where("vec_id is not null and label is not null")
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / block).alias("blocks"))
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", F.isnull)
    rows = rows.join(sizes, "label").select("label", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), "vec_id", F.when(whole, F.col("embedding")).alias("x"))
    listed = rows.groupBy("label", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("r"))
    flat = {"ids": F.col("r.vec_id"), "sizes": F.transform("r", lambda v: F.coalesce(F.size(v["x"]), F.lit(-1))), "x": F.flatten(F.transform("r", lambda v: F.coalesce(v["x"], F.array().cast(dict(vectors.dtypes)["embedding"]))))}
    one = listed.select("label", "block", *(v.alias(f"a_{n}") for n, v in flat.items()))
    two = listed.select("label", F.col("block").alias("other"), *(v.alias(f"b_{n}") for n, v in flat.items()))
    met = one.join(two, "label").repartition("label", "block", "other").drop("label", "block", "other")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                a, b = (_Block(row[f"{s}_ids"], row[f"{s}_sizes"], row[f"{s}_x"]) for s in "ab")
                b.first_copies(k + 1)
                yield from _nearest(a, b, k)

    kind = dict(vectors.dtypes)["vec_id"]
    found = met.mapInPandas(run, f"vec_id {kind}, near_id {kind}, cosine double, kind int")
    found = found.withColumn("cosine", F.when(F.col("kind") == 0, F.col("cosine")).when(F.col("kind") == 2, F.lit(float("nan"))))
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc_nulls_last("cosine"), "near_id"))
    return found.drop("kind").withColumn("rank", rank).where(F.col("rank") <= k)
