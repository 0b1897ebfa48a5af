"""Exact top-k inner-product search by no-random-access aggregation.

Candidates lie in blocks; each block has, for each component, the list of its vectors sorted by that
component, with the values. For a query q, list j is read from its top if q_j > 0 and from its bottom
if q_j < 0, to the same depth in all lists, and what is read is added to each vector's sum. A vector's
lower bound adds to that sum the worst value of each list not read for it, and its upper bound the value
at which that list stands. Reading stops once no vector outside the best k can still enter: all upper
bounds but those of the contenders lie below the k-th largest lower bound (of this block, or already
known from blocks before). Then the lists are read on for the contenders only, until their sums are their
scores. A query that never stops early reads its lists to the end, where all sums are scores: no vector
is ever fetched by its id.

All queries of a block read to the same depth, so that sums of a whole block of queries are matrix
products of what is newly read. Blocks of queries meet blocks of candidates by an equi-join on the query
block: first one block of candidates, whose k-th scores are a bound for all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: Depths at which bounds are compared, as parts of a list.
_DEPTHS = (1 / 8, 1 / 2, 1)
#: Query columns for which bounds are held at once.
_SLICE = 128


def scaled(vector: str, by: int = 256) -> Column:
    """floor(by * x) of each component as long; null where the vector or a component is null or not finite, or it is empty."""
    bad = F.col(vector).isNull() | (F.size(vector) == 0) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(by) * x.cast("double"))))


def _exact(*arrays: np.ndarray) -> type:
    """The fastest type in which sums of products of these integers are exact; Python's integers beyond 64 bits."""
    most = np.prod([float(np.abs(a.astype(np.float64)).max(initial=0)) for a in arrays]) * arrays[0].shape[1] * 2
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond are the largest or smallest of these."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in scores], np.int64)


def nra(block: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray, stopped: list[float] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, the places in ``block`` and scores of all that can be among its best k.

    own: ids of the queries, which are no candidates for themselves. known: k-th best scores so far.
    ``stopped`` gets the part of the lists that each query read before it stopped.
    """
    n, dims = block.shape
    kind = _exact(block, queries)
    order = np.argsort(block, axis=0, kind="stable")
    rank = np.empty((n, dims), np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None] * np.ones((1, dims), np.int32), axis=0)
    lists = np.take_along_axis(block, order, axis=0)
    x, up, down = block.astype(kind), np.maximum(queries, 0).T.astype(kind), np.minimum(queries, 0).T.astype(kind)
    worst_h, worst_l = lists[0].astype(kind), lists[-1].astype(kind)
    steps, before = [], 0
    for part in _DEPTHS:
        depth = n if part == 1 else int(np.ceil(n * part))
        unread_h, unread_l = rank < n - depth, rank >= depth
        # newly read from the top and from the bottom; what isn't read yet; where the lists stand
        fresh = x * ((rank < n - before) & ~unread_h), x * ((rank >= before) & ~unread_l)
        steps.append((part, *fresh, unread_h.astype(kind), unread_l.astype(kind), lists[max(0, n - depth)].astype(kind), lists[depth - 1].astype(kind)))
        before = depth
    out: list[tuple[np.ndarray, np.ndarray]] = [None] * len(queries)
    for at in range(0, len(queries), _SLICE):
        mine = np.arange(at, min(at + _SLICE, len(queries)))
        sums = np.zeros((n, len(mine)), kind)
        for part, fresh_h, fresh_l, unread_h, unread_l, stand_h, stand_l in steps:
            u, d = up[:, mine], down[:, mine]
            sums += fresh_h @ u + fresh_l @ d
            upper = lower = sums
            if part < 1:
                upper = sums + unread_h @ (u * stand_h[:, None]) + unread_l @ (d * stand_l[:, None])
                lower = sums + unread_h @ (u * worst_h[:, None]) + unread_l @ (d * worst_l[:, None])
            still = []
            for c, q in enumerate(mine):
                allowed = np.flatnonzero(ids != own[q])
                bound = known[q]
                if len(allowed) > k:
                    bound = max(bound, np.partition(lower[allowed, c], len(allowed) - k)[len(allowed) - k])
                rivals = allowed[upper[allowed, c] >= bound]
                if part == 1 or len(rivals) <= 4 * k:
                    scores = sums[rivals, c] + (x[rivals] * unread_h[rivals]) @ u[:, c] + (x[rivals] * unread_l[rivals]) @ d[:, c] if part < 1 else sums[rivals, c]
                    out[q] = (rivals, _as_long(scores))
                    if stopped is not None:
                        stopped.append(part)
                else:
                    still.append(c)
            if not still:
                break
            mine, sums = mine[still], sums[:, still]
    return out


def _search(k: int):
    """A partition of (query block, candidate block) rows to each query's best k in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q, floor, c_ids, c, dims in frame[["q_ids", "q", "floor", "c_ids", "c", "dims"]].itertuples(index=False):
                q_ids, c_ids = np.asarray(q_ids, np.int64), np.asarray(c_ids, np.int64)
                queries, block = np.asarray(q, np.int64).reshape(-1, dims), np.asarray(c, np.int64).reshape(-1, dims)
                known = np.array([-np.inf if x is None or x != x else x for x in floor], np.float64)
                known = np.nextafter(known, -np.inf)  # a rounded long is never above its value
                best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
                for at in range(0, len(block), 4096):
                    ids = c_ids[at : at + 4096]
                    for i, (places, scores) in enumerate(nra(block[at : at + 4096], ids, queries, q_ids, k, known)):
                        vec, score = np.append(best[i][0], ids[places]), np.append(best[i][1], scores)
                        top = np.lexsort((vec, -score.astype(object) if score.size and score.min() == -(2**63) else -score))[:k]
                        best[i] = (vec[top], score[top])
                        if len(top) == k:
                            known[i] = max(known[i], np.nextafter(float(score[top[-1]]), -np.inf))
                yield pd.DataFrame(
                    {"query_id": np.repeat(q_ids, [len(v) for v, _ in best]), "vec_id": np.concatenate([v for v, _ in best]), "score": np.concatenate([s for _, s in best])}
                )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, the k best of all other rows.

    Scores are inner products of floor(256 * component); ties go to smaller ids. Components beyond 64 bits
    count as the largest or smallest integer of 64 bits, and so do scores (which are compared as such). Vectors
    that are null, empty or hold a null or non-finite component, and rows with a null id, take no part. Vectors of
    different lengths are never compared. Repeated rows (id and vector) count once; other rows with an
    equal id are rows of their own, but none is a candidate for a query of that id, and their results
    are merged. With fewer than k candidates all are returned; an empty table gives an empty result.
    Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(vector_col).alias("x"), is_query.alias("is_query"))
    rows = rows.where("id is not null and x is not null").withColumn("dims", F.size("x"))
    # the hash also takes in the vector, so that many rows of one id don't meet in one block
    unique = common.cut(rows.dropDuplicates(["id", "x"]).withColumn("h", F.xxhash64("id", "x")), "vectors")
    n = unique.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    query_blocks, blocks = max(1, -(-n[1] // query_block)), max(1, -(-n[0] // block))

    def grouped(df: DataFrame, parts: int, name: str) -> DataFrame:
        lists = F.collect_list(F.struct("id", "x", "floor"))
        out = df.groupBy("dims", F.pmod("h", F.lit(parts)).alias(f"{name}_block")).agg(lists.alias("rows"))
        return out.select("dims", f"{name}_block", F.col("rows.id").alias(f"{name}_ids"), F.flatten("rows.x").alias(name), F.col("rows.floor").alias("floor"))

    c = grouped(unique.withColumn("floor", F.lit(None).cast("long")), blocks, "c").drop("floor").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")))

    def search(queries: DataFrame, some: Column, parts: int) -> DataFrame:
        """A task for each pair of blocks, as far as a job may have as many."""
        met = c.where(some).join(grouped(queries, query_blocks, "q"), ["dims", "q_block"]).select("q_ids", "q", "floor", "c_ids", "c", "dims", "q_block", "c_block")
        met = met.repartition(max(1, min(parts, 50_000)), "q_block", "c_block").drop("q_block", "c_block")
        return met.mapInPandas(_search(k), "query_id long, vec_id long, score long")

    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = unique.where("is_query")
    local = search(queries.withColumn("floor", F.lit(None).cast("long")), F.col("c_block") == 0, query_blocks)
    if blocks > 1:
        local = common.cut(local, "first_block")
        kth = local.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        local = local.unionByName(search(queries.join(kth, "id", "left"), F.col("c_block") > 0, query_blocks * (blocks - 1)))
    return local.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
