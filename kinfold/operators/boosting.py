"""Boosted trees of two classes, fitted by tasks that hold the rows: a byte a feature, from the first tree to the last.

The method is that of Spark's ``GBTClassifier``: trees of squared error over the residuals of the logistic loss, the first over the labels themselves,
rows drawn for each tree and features for each node, held-out rows that stop the boosting. Spark reads all rows again for each level of each tree;
here one barrier stage deals them out once. Its tasks count the smaller child of each split, the larger is what remains of the parent,
and only the sums of the counts travel, along a tree of connections between the tasks. Every row is trained on, and thresholds are quantiles of all rows.
"""

from __future__ import annotations

import json
import os
import pickle
import secrets
import socket
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: Most weighted values that stand for a feature's distribution, by partition.
_POINTS = 4096
#: Most cells of a histogram of several features at once, and of all its nodes.
_PACKED, _CELLS = 4096, 1 << 18
#: Rows that are worked on at once.
_ROWS = 1 << 16


@dataclass
class Boosting:
    depth: int
    rounds: int
    step: float
    bins: int
    min_child: int
    subsample: float
    feature_share: float
    tolerance: float
    seed: int


# --- thresholds -----------------------------------------------------------------------------------


def _condensed(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their counts; more than ``most`` become that many quantiles, the first and the last value among them."""
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    kept = np.unique(np.searchsorted(upto, upto[-1] * np.arange(most) / (most - 1)).clip(max=len(values) - 1))
    return values[kept], np.diff(upto[kept], prepend=0)


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with the sums of their counts."""
    values, at = np.unique(values, return_inverse=True)
    return values, np.bincount(at, counts, minlength=len(values))


def _cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 thresholds midway between neighbouring values, in steps of about equal counts."""
    last = np.arange(len(values) - 1)
    if len(values) > bins:  # as Spark does: the steps that a frequent value takes at once go to the values after it
        upto, kept, target = np.cumsum(counts).tolist(), [], counts.sum() / bins
        for i in range(len(upto) - 1):
            if len(kept) < bins - 1 and abs(upto[i] - target) < abs(upto[i + 1] - target):
                kept.append(i)
                target += upto[-1] / bins
        last = np.array(kept, np.int64)
    return (values[last] + values[last + 1]) / 2


def thresholds(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """The thresholds of each column, from all rows; a value that isn't above one is on its left. Missing values are beyond the last."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.zeros(0), np.zeros(0))] * len(columns)

        def add(part: list[pa.RecordBatch]) -> None:
            for i, c in enumerate(columns):
                x = np.sort(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in part]).astype(float))
                x = x[: np.searchsorted(x, np.nan)]
                last = np.flatnonzero(np.append(x[1:] != x[:-1], True)[: len(x)])
                x, n = _condensed(x[last], np.diff(last, prepend=-1), _POINTS)
                known[i] = _condensed(*_merged(np.concatenate([known[i][0], x]), np.concatenate([known[i][1], n])), _POINTS)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 18:
                add(held)
                held, rows = [], 0
        if held:
            add(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), *(pa.array([k[j].tolist() for k in known], pa.list_(pa.float64())) for j in (0, 1))], ["feature", "x", "n"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        x, n = _merged(np.concatenate(rows["x"].tolist()), np.concatenate(rows["n"].tolist()))
        return pd.DataFrame({"feature": rows["feature"][:1], "x": [_cuts(x, n, bins).tolist()]})

    parts = df.select(*columns).mapInArrow(summed, "feature int, x array<double>, n array<double>")
    found = {r["feature"]: np.array(r["x"]) for r in parts.groupBy("feature").applyInPandas(merged, "feature int, x array<double>").collect()}
    return [found.get(i, np.zeros(0)) for i in range(len(columns))]


# --- tasks that work together ---------------------------------------------------------------------


class Links:
    """A tree of connections between the tasks of a barrier stage: sums go up to the first task, what that decides comes down."""

    def __init__(self, context: BarrierTaskContext):
        self.rank, infos = context.partitionId(), context.getTaskInfos()
        key = secrets.token_bytes(32)
        listener = Listener((infos[self.rank].address.rsplit(":", 1)[0], 0), backlog=4, authkey=key)
        all_ = [json.loads(m) for m in context.allGather(json.dumps([*listener.address[:2], key.hex()]))]
        self.parent = None
        if self.rank:
            host, port, theirs = all_[(self.rank - 1) // 2]
            self.parent = Client((host, port), authkey=bytes.fromhex(theirs))
            self.parent.send(self.rank)
        found = {}
        for _ in range(sum(c < len(all_) for c in (2 * self.rank + 1, 2 * self.rank + 2))):
            child = listener.accept()
            found[child.recv()] = child
        self.children = [found[k] for k in sorted(found)]  # sums are always made in this order
        listener.close()
        for c in (self.parent, *self.children):
            if c:  # small messages go at once
                with socket.socket(fileno=os.dup(c.fileno())) as s:
                    s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum over all tasks, at the first one."""
        for child in self.children:
            x = x + np.frombuffer(child.recv_bytes(), x.dtype).reshape(x.shape)
        if self.parent:
            self.parent.send_bytes(np.ascontiguousarray(x).view(np.uint8).ravel())
        return x

    def told(self, x):
        """What the first task says."""
        said = self.parent.recv_bytes() if self.parent else pickle.dumps(x)
        for child in self.children:
            child.send_bytes(said)
        return pickle.loads(said)

    def close(self) -> None:
        for c in (self.parent, *self.children):
            if c:
                c.close()


class _Table:
    """A task's rows in bins, and histograms over them. Features of few bins are counted together and told apart afterwards."""

    def __init__(self, bins: np.ndarray, widths: list[int]):
        self.bins = np.ascontiguousarray(bins)  # each feature's rows together
        self.flat, self.n = self.bins.ravel(), bins.shape[1]
        self.used = [f for f, w in enumerate(widths) if w > 1]
        self.widths = np.array([*(widths[f] for f in self.used), 1])  # the last is all rows
        self.ends = np.cumsum(self.widths)
        self.starts = self.ends - self.widths
        self.packs: list[tuple[list[int], np.ndarray]] = []
        pack: list[int] = []
        for k in [*sorted(range(len(self.used)), key=lambda k: (self.widths[k], k)), None]:
            if pack and (k is None or self.widths[pack].prod() * self.widths[k] > _PACKED):
                self.packs.append((pack, self._together(pack)))
                pack = []
            pack = [*pack, k]

    def _together(self, pack: list[int]) -> np.ndarray:
        if len(pack) == 1:
            return self.bins[self.used[pack[0]]]
        code = np.zeros(self.n, np.uint16)
        for k in pack:
            code = code * np.uint16(self.widths[k]) + self.bins[self.used[k]]
        return code

    def histograms(self, rows: np.ndarray, at: np.ndarray, slot_of: np.ndarray, target: np.ndarray) -> np.ndarray:
        """(counts and sums of the target, slot, bins of all features) of rows at nodes that have a slot."""
        slots = int(slot_of.max()) + 1
        out = np.zeros((2, slots, int(self.ends[-1])))
        jobs = []
        for pack, code in self.packs:
            if len(pack) == 1 or slots * self.widths[pack].prod() <= min(_CELLS, len(rows) // 8):
                jobs.append((pack, code))
            else:
                jobs += [([k], self.bins[self.used[k]]) for k in pack]
        sums: list = [None] * len(jobs)
        step = max(_ROWS, 2048 * slots)
        for first in range(0, len(rows), step):
            r, s = rows[first : first + step], slot_of.take(at[first : first + step])
            some = np.flatnonzero(s >= 0)
            if len(some) < len(r):
                r, s = r.take(some), s.take(some)
            g = target.take(r)
            for k, (pack, code) in enumerate(jobs):
                width = int(self.widths[pack].prod())
                cells = code.take(r).astype(np.int64)
                if slots > 1:
                    cells += s * width
                mine = np.bincount(cells, minlength=slots * width), np.bincount(cells, g, minlength=slots * width)
                sums[k] = [x + y for x, y in zip(sums[k], mine, strict=True)] if sums[k] else mine
            out[0, :, -1] += np.bincount(s, minlength=slots)
            out[1, :, -1] += np.bincount(s, g, minlength=slots)
        for (pack, _), mine in zip(jobs, sums if len(rows) else [], strict=False):
            for which, cube in enumerate(x.reshape(slots, *self.widths[pack]) for x in mine):
                for axis, k in enumerate(pack):
                    out[which, :, self.starts[k] : self.ends[k]] = cube.sum(axis=tuple(1 + x for x in range(len(pack)) if x != axis)) if len(pack) > 1 else cube
        return out

    def follow(self, rows: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, then: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that go on, and where to. then: by node and side the place at the next level, or ~ the leaf, which is noted in ``leaf``."""
        first, then, kept = feature * self.n, then.ravel(), []
        for i in range(0, len(rows), _ROWS):
            r, k = rows[i : i + _ROWS], at[i : i + _ROWS]
            side = self.flat.take(first.take(k) + r) > cut.take(k)
            k = then.take(2 * k + side)
            ended = np.flatnonzero(k < 0)
            if len(ended):
                leaf[r.take(ended)] = ~k.take(ended)
                on = np.flatnonzero(k >= 0)
                r, k = r.take(on), k.take(on)
            kept.append((r, k))
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (rows, at)

    def best_splits(self, hist: np.ndarray, allowed: np.ndarray, min_child: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the feature or -1, bin, gain of a row, count and sum of the left part) of each node; of equal gains the first."""
        upto = np.cumsum(hist, axis=2)
        before = np.concatenate([np.zeros((2, hist.shape[1], 1)), upto[:, :, self.ends[:-1] - 1]], axis=2)
        n, s = upto - np.repeat(before, self.widths, axis=2)
        all_n, all_s = hist[0, :, -1:], hist[1, :, -1:]
        valid = (n >= min_child) & (all_n - n >= min_child) & np.repeat(allowed, self.widths, axis=1)
        gain = np.where(valid, s * s / np.maximum(n, 1) + (all_s - s) ** 2 / np.maximum(all_n - n, 1), -np.inf)
        best, rows = gain.argmax(axis=1), np.arange(len(gain))
        more = (gain[rows, best] - (all_s * all_s / np.maximum(all_n, 1))[:, 0]) / np.maximum(all_n[:, 0], 1)
        k = np.searchsorted(self.ends, best, side="right")
        return np.where(more > 1e-12, k, -1), best - self.starts[k], more, np.stack([n[rows, best], s[rows, best]])


def _tree(links: Links, table: _Table, target: np.ndarray, drawn: np.ndarray, features: int, b: Boosting, rng: np.random.Generator) -> tuple[np.ndarray, list[dict]]:
    """(each row's prediction, the nodes as the first task knows them). drawn: the rows to learn from; the others follow the splits."""
    leaf = np.zeros(table.n, np.int64)
    active = [(rows, np.zeros(len(rows), np.int64)) for rows in (np.flatnonzero(drawn), np.flatnonzero(~drawn))]
    nodes: list[dict] = [{}]
    ids, slot_of, parents, small = np.zeros(1, np.int64), np.zeros(1, np.int64), None, None
    for level in range(b.depth):
        made = links.total(table.histograms(*active[0], slot_of, target))
        said = None
        if links.parent is None:
            if parents is None:
                hist = made
                nodes[0] = {"n": made[0, 0, -1], "sum": made[1, 0, -1]}
            else:  # the larger child is the parent without the smaller
                hist = np.where(small[None, :, None], made[:, parents[1]], parents[0] - made[:, parents[1]])
            draws = rng.random((len(ids), features))
            least = np.sort(draws, axis=1)[:, int(np.ceil(b.feature_share * features)) - 1, None]
            allowed = np.concatenate([(draws <= least)[:, table.used], np.zeros((len(ids), 1), bool)], axis=1)
            k, cut, gain, left = table.best_splits(hist, allowed, b.min_child)
            children, opened = np.full((len(ids), 2), -1), []
            for i in np.flatnonzero(k >= 0).tolist():
                me = nodes[ids[i]]
                children[i] = len(nodes), len(nodes) + 1
                me |= {"feature": table.used[k[i]], "bin": int(cut[i]), "gain": float(gain[i]), "children": children[i].tolist()}
                nodes.append({"n": left[0, i], "sum": left[1, i]})
                nodes.append({"n": me["n"] - left[0, i], "sum": me["sum"] - left[1, i]})
                sizes = [nodes[c]["n"] for c in children[i]]
                if level + 1 < b.depth and max(sizes) >= 2 * b.min_child:
                    less = int(sizes[1] < sizes[0])
                    opened.append((i, less))
            inner = np.full((len(ids), 2), -1)
            of, less = (np.array(x, np.int64) for x in zip(*opened, strict=True)) if opened else (np.zeros(0, np.int64),) * 2
            inner[of] = 2 * np.arange(len(of))[:, None] + [0, 1]
            slot_of = np.full(2 * len(of), -1)
            slot_of[2 * np.arange(len(of)) + less] = np.arange(len(of))
            small = slot_of >= 0
            parents = np.repeat(hist[:, of], 2, axis=1), np.repeat(np.arange(len(of)), 2)
            then = np.where(inner >= 0, inner, ~np.where(children >= 0, children, ids[:, None]))
            said = np.array([*table.used, 0])[k], np.where(k >= 0, cut, 0), then, children[of].ravel(), slot_of
        feature, cut, then, ids, slot_of = links.told(said)
        active = [table.follow(rows, at, feature, cut, then, leaf) for rows, at in active]
        if not len(ids):
            break
    values = links.told(np.array([x["sum"] / max(1, x["n"]) for x in nodes]) if links.parent is None else None)
    return values[leaf], nodes


def _boosted(links: Links, bins: np.ndarray, label: np.ndarray, held: np.ndarray, widths: list[int], b: Boosting) -> list[tuple[float, list[dict]]]:
    """(weight, nodes) of each tree up to the best one for the held rows."""
    table, y = _Table(bins, widths), np.where(label > 0, 1.0, -1.0)
    score, trees, best, kept = np.zeros(len(y)), [], np.inf, 0
    any_held = links.told(bool(links.total(np.array([float(held.sum())]))[0]))
    for m in range(b.rounds):
        rng = np.random.default_rng([b.seed, m, links.rank])
        target = 4 * y / (1 + np.exp(np.minimum(2 * y * score, 700))) if m else y
        drawn = (rng.random(len(y)) < b.subsample) & ~held
        weight = b.step if m else 1.0
        predicted, nodes = _tree(links, table, target, drawn, len(widths), b, rng)
        score += weight * predicted
        trees.append((weight, nodes))
        if any_held:
            loss = links.total(np.array([2 * np.logaddexp(0, -2 * y[held] * score[held]).sum(), held.sum()]))
            if links.parent is None:
                now = loss[0] / loss[1]
                stop = best - now < b.tolerance * max(now, 0.01)
                if not stop:
                    best, kept = now, m + 1
            if links.told(None if links.parent else stop):
                break
    return trees[:kept] if any_held else trees


# --- the whole fit --------------------------------------------------------------------------------


def _tasks(spark: SparkSession) -> int:
    """As many tasks as run at once."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def fit(df: DataFrame, columns: list[str], learns: list[Column], b: Boosting, features_col: str = "_x") -> list[GBTClassificationModel]:
    """A model for each condition of ``learns``, which says what rows it learns from; the rows are dealt out once for all of them.

    df: ``columns``, label (0 or 1) and held; rows of held only stop the boosting, of each model.
    """
    spark = df.sparkSession
    df = df.select(*columns, "label", "held", *(c.alias(f"_learn{k}") for k, c in enumerate(learns)))
    cuts = thresholds(df.where(~F.col("held")), columns, b.bins)
    widths, flags = [len(c) + 1 for c in cuts], df.columns[len(columns) :]
    kind = np.uint8 if max(widths) <= 256 else np.uint16

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            out = np.empty((len(columns), batch.num_rows), kind)
            for i, c in enumerate(columns):
                out[i] = np.searchsorted(cuts[i], column(c).astype(float))
            more = (column(c).astype(np.uint8).tobytes() for c in flags)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (out.tobytes(), *more)], ["bins", *flags])

    def run(rows: Iterator) -> Iterator[list]:
        parts = [[np.zeros((len(columns), 0), kind)], *([np.zeros(0, np.uint8)] for _ in flags)]
        for x, *more in rows:
            parts[0].append(np.frombuffer(x, kind).reshape(len(columns), -1))
            for part, y in zip(parts[1:], more, strict=True):
                part.append(np.frombuffer(y, np.uint8))
        bins, label, held, *mine = (np.concatenate(p, axis=-1) for p in parts)
        parts.clear()
        links, found = Links(BarrierTaskContext.get()), []
        for k in range(len(mine)):
            some = np.flatnonzero((mine[k] > 0) | (held > 0))
            found.append(_boosted(links, np.take(bins, some, axis=1), label[some], held[some] > 0, widths, b))
        links.close()
        if links.rank == 0:
            yield found

    blobs = df.mapInArrow(binned, ", ".join(f"{c} binary" for c in ("bins", *flags)))
    found = blobs.repartition(_tasks(spark)).rdd.barrier().mapPartitions(run).collect()[0]
    return [_as_model(spark, trees, cuts, b, features_col) for trees in found]


def _as_model(spark: SparkSession, trees: list[tuple[float, list[dict]]], cuts: list[np.ndarray], b: Boosting, features_col: str) -> GBTClassificationModel:
    """Spark's model of these trees, by way of its stored form. Impurities of nodes aren't kept (0), their gains are."""
    path = f"{store.shared_dir(spark)}/kinfold-{uuid.uuid4().hex}"
    params = {"featuresCol": features_col, "labelCol": "label", "maxDepth": b.depth, "maxBins": b.bins, "minInstancesPerNode": b.min_child, "seed": b.seed}
    common = lambda kind, more: {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": f"boosted_{uuid.uuid4().hex[:12]}", "paramMap": more, "defaultParamMap": {"impurity": "variance"}}
    whole = params | {"maxIter": b.rounds, "stepSize": b.step, "subsamplingRate": b.subsample, "featureSubsetStrategy": str(b.feature_share), "validationTol": b.tolerance}
    meta = common("classification.GBTClassificationModel", whole) | {"numFeatures": len(cuts), "numTrees": len(trees)}
    one = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    one([(json.dumps(meta),)], "value string").write.text(f"{path}/metadata")
    one([(i, json.dumps(common("regression.DecisionTreeRegressionModel", params)), w) for i, (w, _) in enumerate(trees)], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    rows = []
    for tree, (_, nodes) in enumerate(trees):
        for i, x in enumerate(nodes):
            n, mean = float(x["n"]), float(x["sum"] / max(1, x["n"]))
            f, (left, right) = x.get("feature", -1), x.get("children", (-1, -1))
            split = (f, [float(cuts[f][x["bin"]])] if f >= 0 else [], -1)
            rows.append((tree, (i, mean, 0.0, [n, n * mean, n * mean * mean], int(n), x.get("gain", -1.0), left, right, split)))
    node = "id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int"
    one(rows, f"treeID int, nodeData struct<{node.replace(' ', ':').replace(',:', ', ')}, split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>").write.parquet(f"{path}/data")
    model = GBTClassificationModel.load(path)
    store.delete(spark, path)
    return model
