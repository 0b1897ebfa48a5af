"""Reverse retrieval: each noisy record looks up its best reference records in its own country.

The weights are TF-IDF of character 3-grams, the best are those of three channels (name, address, blend).
The plain form (``score_pairs``) is an inverted index as an equi-join on (country, gram), which lists all pairs
that share a gram. ``retrieve_exact`` has the same best from blocks of queries and references: a block's
inverted index is read in memory and only the best of each query leave it. The sketched path multiplies
blocks in sketches of ``dim`` signed dimensions, takes more of the best than are asked for, and gives these
their exact cosines from the same sparse weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..functions.similarity import text_scores
from ..sources import store


def char_grams(text: Column | str, n: int = 3) -> Column:
    """Character n-grams of each word with a space on both sides."""
    padded = F.transform(tx.words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))))


def gram_counts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, gram, tf)"""
    return docs.select(*keys, F.explode(char_grams(text)).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gram").agg(F.count("*").alias("df"))


def channel_cosines(ref: DataFrame, queries: DataFrame, text: str, name: str) -> DataFrame:
    """(q, s1, name): cosine of one text column for pairs of a country that share a gram. ref: (s1, country, text); queries: (q, country, text)."""
    rc, qc = gram_counts(ref, ["s1", "country"], text), gram_counts(queries, ["q", "country"], text)
    df = document_frequency(rc)
    n = ref.agg(F.count("*").alias("n_docs"))
    rw, qw = weighted(rc, df, n, ["s1", "country"]), weighted(qc, df, n, ["q", "country"])
    pairs = qw.withColumnRenamed("w", "wq").join(rw.withColumnRenamed("w", "wr"), ["country", "gram"])
    return pairs.groupBy("q", "s1").agg(F.sum(F.col("wq") * F.col("wr")).alias(name))


def weighted(counts: DataFrame, df: DataFrame, n: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, w): log1p(tf) * (ln((n + 1) / (df + 1)) + 1), scaled to length 1 for each document; df 0 for grams of no reference."""
    df = df.join(F.broadcast(n))  # one row
    idf = counts.join(df.select("gram", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "gram", "left")
    unseen = idf.join(F.broadcast(n)).withColumn("idf", F.coalesce("idf", F.log(F.col("n_docs") + 1.0) + 1))
    raw = unseen.select(*keys, "gram", (F.log1p("tf") * F.col("idf")).alias("raw"))
    norm = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, keys).select(*keys, "gram", (F.col("raw") / F.col("norm")).alias("w"))


def blend_weight(w_name: float) -> Column:
    """The name's weight of a query row (addr_empty, name_key): 1 without an address, 0 without a name."""
    return F.when(F.col("name_key") == "", 0.0).when(F.col("addr_empty"), 1.0).otherwise(w_name)


def score_pairs(ref: DataFrame, queries: DataFrame, w_name: float = 0.5) -> DataFrame:
    """(q, s1, sn, sa, w_name, comb) for all pairs of a country that share a gram in name or address."""
    both = channel_cosines(ref, queries, "name_key", "sn").select("q", "s1", "sn", F.lit(0.0).alias("sa")).unionByName(
        channel_cosines(ref, queries, "addr_clean", "sa").select("q", "s1", F.lit(0.0).alias("sn"), "sa")
    )
    pairs = both.groupBy("q", "s1").agg(F.sum("sn").alias("sn"), F.sum("sa").alias("sa"))
    pairs = pairs.join(queries.select("q", blend_weight(w_name).alias("w_name")), "q")
    return pairs.withColumns({"sn": F.round("sn", 6), "sa": F.round("sa", 6)}).withColumn("comb", F.col("w_name") * F.col("sn") + (1 - F.col("w_name")) * F.col("sa"))


def best_by(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """The k best pairs of each query by one score; ties to the smaller s1."""
    return pairs.withColumn("_k", F.row_number().over(W.partitionBy("q").orderBy(F.desc(score), "s1"))).where(F.col("_k") <= k)


def query_stats(pairs: DataFrame) -> DataFrame:
    """(q, q_comb1, q_comb2, q_sn1, q_sa1): best and second-best blend (0 if there is no second), best name and address cosine."""
    top = best_by(pairs, "comb", 2).groupBy("q").agg(F.max(F.when(F.col("_k") == 1, F.col("comb"))).alias("q_comb1"), F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("comb"))), F.lit(0.0)).alias("q_comb2"))
    return top.join(pairs.groupBy("q").agg(F.max("sn").alias("q_sn1"), F.max("sa").alias("q_sa1")), "q")


def candidates(pairs: DataFrame, k_name: int = 3, k_addr: int = 3, k_comb: int = 8, few: bool = False) -> DataFrame:
    """Union of the three channels' best, each pair once, with its query's statistics.

    Each channel is limited before anything is shuffled; what a query's statistics need is among the kept pairs
    (the blend's first two, and the best name and address). few: the pairs are few and each is there once, as a retrieval
    by blocks leaves them; then they are shuffled as they are, so that they are made once and not for each channel.
    """
    slim = pairs.select("q", "s1", "sn", "sa", "w_name", "comb")
    ranks = {f"_{c}": F.row_number().over(W.partitionBy("q").orderBy(F.desc(c), "s1")) for c in ("comb", "sn", "sa")}
    if not few:
        kept = [best_by(slim, c, k).drop("_k") for c, k in (("comb", max(2, k_comb)), ("sn", max(1, k_name)), ("sa", max(1, k_addr)))]
        slim = kept[0].unionByName(kept[1]).unionByName(kept[2]).dropDuplicates(["q", "s1"])
    out = slim.withColumns(ranks)
    by = W.partitionBy("q")
    second = F.max(F.when(F.col("_comb") == 2, F.col("comb"))).over(by)
    stats = {"q_comb1": F.max("comb").over(by), "q_comb2": F.coalesce(second, F.lit(0.0)), "q_sn1": F.max("sn").over(by), "q_sa1": F.max("sa").over(by)}
    return out.withColumns(stats).where((F.col("_comb") <= k_comb) | (F.col("_sn") <= k_name) | (F.col("_sa") <= k_addr)).drop(*ranks)


# --- exact path by blocks -----------------------------------------------------------------------

_NEAR = 2e-6  # scores this close can change places when they are rounded to 6 digits


class _Index:
    """Inverted index of the distinct texts of a block of references, and of which text each reference has."""

    def __init__(self, texts, sizes, grams, weights, of):
        sizes = np.asarray(sizes, np.int64)
        place = {t: i for i, t in enumerate(texts)}
        self.at = np.fromiter((place[t] for t in of), np.int64, len(of))
        self.n = len(sizes)
        grams, weights, rows = np.asarray(grams, np.int64), np.asarray(weights, np.float64), np.repeat(np.arange(self.n), sizes)
        if self.n == len(self.at):  # all differ: in the order of the references, so that nothing is looked up
            rows, self.at = np.argsort(self.at)[rows], None
        order = np.lexsort((rows, grams))
        known, first = np.unique(grams[order], return_index=True)
        ends = np.append(first[1:], len(order))
        rows, weights = rows[order], weights[order]
        self.posts = {g: (rows[a:b], weights[a:b]) for g, a, b in zip(known.tolist(), first.tolist(), ends.tolist(), strict=True)}

    def cosines(self, grams: list, weights: list) -> np.ndarray:
        """Cosine of one text with each text of the block."""
        out = np.zeros(self.n)
        for g, w in zip(grams, weights, strict=True):
            if g in self.posts:
                rows, theirs = self.posts[g]
                out[rows] += w * theirs
        return out

    def spread(self, cosines: np.ndarray) -> np.ndarray:
        """From texts to references."""
        return cosines if self.at is None else cosines[self.at]


def _at_least(score: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores that can be among the k best: those from the k-th best of k parts' maxima on (or from the k-th best on, if that leaves many)."""
    if len(score) > 64 * k:
        parts = 16 * k
        width = len(score) // parts
        low = np.partition(score[: width * parts].reshape(parts, width).max(axis=1), parts - k)[parts - k]
        found = np.flatnonzero(score >= low - _NEAR)
    else:
        found = np.arange(len(score))
    if len(found) > 4 * k:
        mine = score[found]
        found = found[mine >= np.partition(mine, len(mine) - k)[len(mine) - k] - _NEAR]
    return found


def _best(score: np.ndarray, shares: np.ndarray, rounded: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Places of the k best of the pairs that share a gram, by the rounded score; ties to the smaller place."""
    if k < 1:
        return np.zeros(0, np.int64)
    found = _at_least(score, k)
    found = found[shares[found]]
    if len(found) < k:  # the best are followed by pairs whose score is 0
        found = np.flatnonzero(shares)
    mine = rounded(found)
    if len(found) > 4 * k:
        kept = mine >= np.partition(mine, len(mine) - k)[len(mine) - k]
        found, mine = found[kept], mine[kept]
    return found[np.lexsort((found, -mine))[:k]]


def _search(row: dict, k_name: int, k_addr: int, k_comb: int) -> Iterator[pd.DataFrame]:
    """The best references of a block for each query of another, by channel. Queries of the same texts are one."""
    s_ids, q_ids = np.asarray(row["ss_id"]), np.asarray(row["qs_id"])
    index = {c: _Index(*(row[f"ss_{c}_{x}"] for x in ("text", "size", "g", "w", "of"))) for c in "na"}
    theirs = {}
    for c in "na":
        ends = np.cumsum(np.asarray(row[f"qs_{c}_size"], np.int64)).tolist()
        g, w = np.asarray(row[f"qs_{c}_g"], np.int64), np.asarray(row[f"qs_{c}_w"], np.float64)
        theirs[c] = {t: (g[a:b].tolist(), w[a:b].tolist()) for t, a, b in zip(row[f"qs_{c}_text"], [0, *ends[:-1]], ends, strict=True)}
    groups: dict = {}
    for i, key in enumerate(zip(row["qs_a_of"], row["qs_n_of"], np.asarray(row["qs_w_name"], float).tolist(), strict=True)):
        groups.setdefault(key, []).append(i)
    kept: dict = {}
    room = max(1, (1 << 22) // (1 + index["n"].n))
    at, found, sa_of = [], [], None
    for address, name, w in sorted(groups):
        if name not in kept:
            if len(kept) >= room:
                kept.clear()
            kept[name] = index["n"].cosines(*theirs["n"].get(name, ((), ())))
        if sa_of != address:
            sa_of, sa = address, index["a"].spread(index["a"].cosines(*theirs["a"].get(address, ((), ()))))
        sn = index["n"].spread(kept[name])
        shares = (sn > 0) | (sa > 0)
        comb = w * sn + (1 - w) * sa
        blend = lambda i: w * np.round(sn[i], 6) + (1 - w) * np.round(sa[i], 6)  # noqa: B023, E731
        tops = [_best(comb, shares, blend, max(2, k_comb)), _best(sn, shares, lambda i: np.round(sn[i], 6), max(1, k_name)), _best(sa, shares, lambda i: np.round(sa[i], 6), max(1, k_addr))]  # noqa: B023
        j = np.unique(np.concatenate(tops))
        at.append((groups[address, name, w], j))
        found.append((np.round(sn[j], 6), np.round(sa[j], 6), w, blend(j)))
        if len(at) == 2048:
            yield _listed(at, found, q_ids, s_ids)
            at, found = [], []
    if at:
        yield _listed(at, found, q_ids, s_ids)


def _listed(at: list, found: list, q_ids: np.ndarray, s_ids: np.ndarray) -> pd.DataFrame:
    n = [len(mine) for mine, _ in at]
    sizes = [len(j) for _, j in at]
    many = lambda parts: np.concatenate([np.tile(x, k) for x, k in zip(parts, n, strict=True)])
    q = np.concatenate([np.repeat(np.asarray(mine, np.int64), k) for (mine, _), k in zip(at, sizes, strict=True)])
    w = np.concatenate([np.full(k * m, x[2]) for x, k, m in zip(found, n, sizes, strict=True)])
    sn, sa, comb = (many([x[c] for x in found]) for c in (0, 1, 3))
    return pd.DataFrame({"q": q_ids[q], "s1": s_ids[many([j for _, j in at])], "sn": sn, "sa": sa, "w_name": w, "comb": comb})


#: Most grams whose frequencies are broadcast.
HELD_GRAMS = 1 << 18


def _text_weights(ref: DataFrame, queries: DataFrame, text: str, n: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """(text, g, w): the weights of each distinct text of references and queries. df: (gram, df) where ``ref`` isn't all references."""
    texts = ref.select(text).unionByName(queries.select(text)).distinct()
    if df is None:
        own = ref.groupBy(text).agg(F.count("*").alias("rows"))
        df = own.select("rows", F.explode(F.array_distinct(char_grams(text))).alias("gram")).groupBy("gram").agg(F.sum("rows").alias("df"))
        df = store.written(df, f"frequencies_{text}")
    if df.count() <= HELD_GRAMS:  # then the grams of a text stay together
        df = F.broadcast(df)
    idf = F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    raw = gram_counts(texts, [text], text).join(df, "gram", "left").join(F.broadcast(n)).select(text, F.xxhash64("gram").alias("g"), (F.log1p("tf") * idf).alias("w"))  # n: one row
    listed = raw.groupBy(text).agg(F.collect_list(F.struct("g", "w")).alias("s"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return listed.select(F.col(text).alias("text"), F.col("s.g").alias("g"), F.transform("s.w", lambda w: w / F.col("norm")).alias("w"))


def _blocked(docs: DataFrame, key: str, name: str, size: int, extra: list[str], weights: dict[str, DataFrame]) -> DataFrame:
    """Blocks of about ``size`` records of a country: ids and texts of the records, and the weights of their distinct texts once, as flat arrays."""
    sizes = docs.groupBy("country").agg(F.ceil(F.count("*") / size).alias("blocks"))
    rows = docs.join(sizes, "country").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
    texts = {"n": F.coalesce("name_key", F.lit("")).alias("n_of"), "a": F.coalesce("addr_clean", F.lit("")).alias("a_of")}
    listed = rows.select("country", "block", F.col(key).alias("id"), *texts.values(), *extra)
    out = listed.groupBy("country", "block").agg(F.array_sort(F.collect_list(F.struct("id", "n_of", "a_of", *extra))).alias("r"))
    out = out.select("country", "block", *(F.col(f"r.{c}").alias(f"{name}_{c}") for c in ("id", "n_of", "a_of", *extra)))
    for c in "na":
        w = listed.select("country", "block", F.col(f"{c}_of").alias("text")).distinct().join(weights[c], "text", "left")
        empty = {"g": F.array().cast("array<bigint>"), "w": F.array().cast("array<double>")}
        w = w.withColumns({x: F.coalesce(x, e) for x, e in empty.items()})
        w = w.groupBy("country", "block").agg(F.collect_list(F.struct("text", "g", "w")).alias("t"))
        flat = {"text": F.col("t.text"), "size": F.transform("t", lambda x: F.size(x["g"])), "g": F.flatten("t.g"), "w": F.flatten("t.w")}
        out = out.join(w.select("country", "block", *(v.alias(f"{name}_{c}_{x}") for x, v in flat.items())), ["country", "block"])
    return out.withColumnRenamed("block", f"{name}_block")


def retrieve_exact(
    ref: DataFrame, queries: DataFrame, w_name: float = 0.5, k_name: int = 3, k_addr: int = 3, k_comb: int = 8, block: int = 32768, ref_block: int = 65536
) -> DataFrame:
    """(q, s1, sn, sa, w_name, comb): of ``score_pairs`` each query's best by channel (at least), for ``candidates``; ties to the smaller s1.

    Blocks of queries meet blocks of references of their country by an equi-join. A block holds the weights of its distinct texts
    once; within a pair of blocks each query's cosines are sums over the posting lists of its grams.
    """
    n = ref.agg(F.count("*").alias("n_docs"))
    weights = {c: store.written(_text_weights(ref, queries, text, n), f"weights_{text}") for c, text in (("n", "name_key"), ("a", "addr_clean"))}

    qb = _blocked(queries.withColumn("w_name", blend_weight(w_name)), "q", "qs", block, ["w_name"], weights)
    sb = _blocked(ref, "s1", "ss", ref_block, [], weights)
    met = sb.join(qb, "country").repartition("country", "qs_block", "ss_block").drop("country", "qs_block", "ss_block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                yield from _search(row, k_name, k_addr, k_comb)

    kinds = dict(queries.dtypes)["q"], dict(ref.dtypes)["s1"]
    return met.mapInPandas(run, f"q {kinds[0]}, s1 {kinds[1]}, sn double, sa double, w_name double, comb double")


# --- sketched path ------------------------------------------------------------------------------

#: Scores of a pair's addresses that the search can add.
ADDRESS_SCORES = ["ad_ratio", "ad_tset", "ad_tsort", "ad_partial"]


def _spans(first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which span, place) of all places of spans of a flat array."""
    sizes = ends - first
    upto = np.cumsum(sizes)
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends - upto, sizes)


class _Side:
    """The sparse weights of the distinct texts of a block in one channel, and which text each record has."""

    def __init__(self, row: dict, name: str):
        place = {t: i for i, t in enumerate(row[f"{name}_text"])}
        self.of = np.fromiter((place[t] for t in row[f"{name}_of"]), np.int64, len(row[f"{name}_of"]))
        self.sizes, self.weights = np.asarray(row[f"{name}_size"], np.int64), np.asarray(row[f"{name}_w"], np.float64)
        self.grams = np.asarray(row[f"{name}_g"], np.int64) & np.int64(2**63 - 1)
        self.n, self.ends = len(self.sizes), np.cumsum(self.sizes)
        self.rows = np.repeat(np.arange(self.n), self.sizes)

    def sketched(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, dimension, value) of weights in ``dim`` signed dimensions, scaled to length 1 for each text, in the order of the texts."""
        cells, at = np.unique(self.rows * dim + self.grams % dim, return_inverse=True)
        out = np.bincount(at, np.where((self.grams >> 40) & 1, -self.weights, self.weights), minlength=len(cells))
        rows, dims = np.divmod(cells, dim)
        norm = np.sqrt(np.bincount(rows, out * out, minlength=self.n))
        return rows, dims, (out / np.where(norm == 0, 1, norm)[rows]).astype(np.float32)

    def numbered(self, known: np.ndarray) -> np.ndarray:
        """The place of each gram in ``known``, sorted; one beyond for others."""
        at = np.searchsorted(known, self.grams)
        return np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == self.grams), at, len(known)) if len(known) else np.zeros(len(self.grams), np.int64)

    def cells(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``some`` texts, place in the flat arrays) of their weights."""
        return _spans(self.ends[some] - self.sizes[some], self.ends[some])


class _Channel:
    """Sketches of two blocks' distinct texts in one channel: posting lists of the references' dimensions, and a matrix of those that many of them have.

    places: (column of each reference, number of columns), where they aren't in their own order.
    """

    def __init__(self, q: _Side, s: _Side, dim: int, places: tuple[np.ndarray, int] | None = None):
        self.q, self.s = q, s
        self.known = np.unique(s.grams)
        self.q_at, self.s_at = q.numbered(self.known), s.numbered(self.known)
        self.table, most = None, int(s.sizes.max(initial=0))
        if most * s.n <= 4 * len(s.grams):  # of like sizes: a row for each text, filled up by a gram of no text
            self.table = np.full((s.n, most), len(self.known), np.int32), np.zeros((s.n, most))
            cells = s.rows, np.arange(len(s.grams)) - np.repeat(s.ends - s.sizes, s.sizes)
            self.table[0][cells], self.table[1][cells] = self.s_at, s.weights
        rows, dims, values = s.sketched(dim)
        self.spread, width = None if places or s.n == len(s.of) else s.of, s.n
        if self.spread is None:  # a column for each reference, so that nothing is looked up
            column, width = places or (np.arange(s.n), s.n)
            first = np.searchsorted(rows, np.arange(s.n + 1))
            of, at = _spans(first[s.of], first[s.of + 1])
            rows, dims, values = column[of], dims[at], values[at]
        order = np.argsort(dims, kind="stable")
        rows, values, ends = rows[order], values[order], np.searchsorted(dims[order], np.arange(dim + 1))
        sizes = np.diff(ends)
        many = np.argsort(-sizes, kind="stable")[: int((sizes * 24 > width).sum())][: max(1, (1 << 24) // max(1, width))]
        self.column = np.full(dim, -1)
        self.column[many] = np.arange(len(many))
        self.matrix = np.zeros((len(many), width), np.float32)
        for i, d in enumerate(many):
            self.matrix[i, rows[ends[d] : ends[d + 1]]] = values[ends[d] : ends[d + 1]]
        self.posts = {d: (rows[ends[d] : ends[d + 1]], values[ends[d] : ends[d + 1]]) for d in np.flatnonzero(sizes).tolist()}
        self.gain = 1500 + 11 * sizes[many]  # ns of a posting list, measured; a cell of a matrix product takes about 0.05
        self.mine = q.sketched(dim)
        self.first = np.searchsorted(self.mine[0], np.arange(q.n + 1))

    def order(self) -> np.ndarray:
        """The rank of each text of the queries by its dimensions in the matrix, so that a batch of neighbours needs few of them."""
        rows, dims, _ = self.mine
        at = self.column[dims]
        has = np.zeros((self.q.n, len(self.matrix) + 1), bool)
        has[rows[at >= 0], at[at >= 0]] = True
        rank = np.empty(self.q.n, np.int64)
        rank[np.lexsort(np.packbits(has, axis=1).T[::-1])] = np.arange(self.q.n)
        return rank

    def products(self, some: np.ndarray) -> np.ndarray:
        """Products of sketches: a row for each of ``some`` texts of the queries, a column for each column of the matrix."""
        of, at = _spans(self.first[some], self.first[some + 1])
        dims, w = self.mine[1][at], self.mine[2][at]
        at = self.column[dims]
        used = np.flatnonzero(np.bincount(at[at >= 0], minlength=len(self.gain)) * self.gain > 0.05 * len(some) * self.matrix.shape[1])
        place = np.full(len(self.gain) + 1, -1)
        place[used] = np.arange(len(used))
        at = place[at]
        dense = at >= 0
        left = np.zeros((len(some), len(used)), np.float32)
        left[of[dense], at[dense]] = w[dense]
        out = left @ self.matrix[used]
        for i, d, x in zip(of[~dense].tolist(), dims[~dense].tolist(), w[~dense].tolist(), strict=True):
            if d in self.posts:
                rows, theirs = self.posts[d]
                out[i][rows] += x * theirs
        return out

    def cosines(self, some: np.ndarray) -> np.ndarray:
        """Cosines of sketches, 0 at least: a row for each of ``some`` texts of the queries, a column for each reference."""
        out = self.products(some)
        np.maximum(out, 0, out=out)
        return out if self.spread is None else np.take(out, self.spread, axis=1)

    def exact(self, some: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cosines of the pairs of the text some[i] and the reference j, to 6 places."""
        if self.s.n == len(self.s.of):
            return self.exact_texts(some, i, self.s.of[j])
        pairs, back = np.unique(i * (1 + self.s.n) + self.s.of[j], return_inverse=True)
        return self.exact_texts(some, *np.divmod(pairs, 1 + self.s.n))[back]

    def exact_texts(self, some: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cosines of the pairs of the text some[i] and the references' text j, to 6 places."""
        width = len(self.known) + 1
        dense = np.zeros(len(some) * width)
        of, at = self.q.cells(some)
        dense[of * width + self.q_at[at]] = self.q.weights[at]
        dense[width - 1 :: width] = 0
        if self.table:
            at, weights = self.table
            return np.round(np.einsum("ij,ij->i", np.take(dense, at[j] + (i * width).astype(np.int32)[:, None]), weights[j]), 6)
        of, at = self.s.cells(j)
        return np.round(np.bincount(of, dense[(i * width)[of] + self.s_at[at]] * self.s.weights[at], minlength=len(j)), 6)


def _top(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k best of each row; equal scores (to 5 places) by place. Scores are 0 to 1."""
    n = score.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(score)), n), np.tile(np.arange(n), len(score))
    parts = min(n, 16 * k)  # the k-th best of the parts' maxima is the k-th best of all at most
    low = np.partition(score[:, : n // parts * parts].reshape(len(score), -1, parts).max(axis=1), parts - k, axis=1)[:, parts - k]
    low = np.maximum(np.rint(low * 1e5), 1) - 0.6  # what rounds to it or more is at least here
    i, j = np.divmod(np.flatnonzero(score >= (low / 1e5).astype(np.float32)[:, None]), n)
    value = np.rint(score[i, j] * np.float32(1e5)).astype(np.int64)
    i, j, value = i[value > 0], j[value > 0], value[value > 0]
    counts = np.bincount(i, minlength=len(score))
    few = np.flatnonzero(counts < k)  # of scores of 0 the first places
    if len(few):
        more = [np.flatnonzero(np.rint(score[r, :k] * np.float32(1e5)) < 1)[: k - counts[r]] for r in few]
        i, j = np.concatenate([i, np.repeat(few, [len(m) for m in more])]), np.concatenate([j, *more])
        value = np.concatenate([value, np.zeros(len(i) - len(value), np.int64)])
    return _ranked(i, j, value, len(score), k)


def _ranked(i: np.ndarray, j: np.ndarray, value: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k best of each row by value; ties by place."""
    key = (i << 38) | ((1 << 17) - 1 - value << 21) | j
    key.sort()
    i, j = key >> 38, key & ((1 << 21) - 1)
    kept = np.arange(len(i)) - np.searchsorted(i, np.arange(rows))[i] < k
    return i[kept], j[kept]


def _first(i: np.ndarray, sn: np.ndarray, sa: np.ndarray, comb: np.ndarray, k: tuple[int, int, int]) -> np.ndarray:
    """Which of the pairs of i, in the order of i and reference, are among the k best of their i by name, address or blend; ties to the first. Pairs with no cosine above zero aren't."""
    keep = np.zeros(len(i), bool)
    if not len(i):
        return keep
    rows, first, sizes = np.unique(i, return_index=True, return_counts=True)
    cells = np.repeat(np.arange(len(rows)), sizes), np.arange(len(i)) - np.repeat(first, sizes)
    for score, most in zip((sn, sa, comb), k, strict=True):
        table = np.full((len(rows), int(sizes.max())), np.inf)
        table[cells] = -score
        last = np.partition(table, min(most, table.shape[1]) - 1, axis=1)[:, min(most, table.shape[1]) - 1, None]
        better, tied = table < last, table == last
        keep |= (better | (tied & (np.cumsum(tied, axis=1) <= most - better.sum(axis=1, keepdims=True))))[cells]
    return keep & ((sn > 0) | (sa > 0))


class _Asked:
    """The queries of a block: those of the same texts and weight are asked once."""

    def __init__(self, row: dict, name: _Side, address: _Side):
        weights, w = np.unique(np.asarray(row["qs_w_name"], float), return_inverse=True)
        keys, at = np.unique((address.of * name.n + name.of) * len(weights) + w, return_inverse=True)
        self.ids, self.n = np.asarray(row["qs_id"])[np.argsort(at, kind="stable")], len(keys)
        self.ends = np.cumsum(np.bincount(at, minlength=len(keys)))
        texts, w = np.divmod(keys, len(weights))
        self.w, (self.address, self.name) = weights[w], np.divmod(texts, name.n)

    def listed(self, i: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        """Rows of all queries from those of the questions."""
        many = np.diff(self.ends, prepend=0)[i]
        ends = np.cumsum(many)
        for at in range(0, int(ends[-1]) if len(ends) else 0, 1 << 18):
            flat = np.arange(at, min(at + (1 << 18), int(ends[-1])))
            of = np.searchsorted(ends, flat, side="right")
            q = self.ids[self.ends[i[of]] - ends[of] + flat]
            yield pd.DataFrame({"q": q} | {c: x[of] for c, x in columns.items()})


class _Shared:
    """A block of references whose names have many references each.

    Columns are parts of references of one name, so that the best blend of a part follows from its best address;
    names are compared once for the block, and only the best parts are looked into.
    """

    def __init__(self, q: dict[str, _Side], s: dict[str, _Side], dim: int):
        self.n = len(s["n"].of)
        by_name = np.argsort(s["n"].of, kind="stable")
        counts = np.bincount(s["n"].of, minlength=s["n"].n)
        self.depth = max(1, min(self.n // 1024, self.n // (4 * s["n"].n)))
        parts = -(-counts // self.depth)
        self.name_of = np.repeat(np.arange(s["n"].n), parts)
        self.parts = len(self.name_of)
        of, at = _spans(np.cumsum(counts) - counts, np.cumsum(counts))
        place = at - (np.cumsum(counts) - counts)[of]
        self.column = np.empty(self.n, np.int64)
        self.column[by_name] = place % self.depth * self.parts + (np.cumsum(parts) - parts)[of] + place // self.depth
        self.ref = np.full(self.depth * self.parts, -1)
        self.ref[self.column] = np.arange(self.n)
        self.ref = self.ref.reshape(self.depth, self.parts)
        self.name, self.address = _Channel(q["n"], s["n"], dim), _Channel(q["a"], s["a"], dim, (self.column, self.depth * self.parts))

    @staticmethod
    def fits(q: dict[str, _Side], s: dict[str, _Side], most: int) -> bool:
        """Whether names are shared enough, and enough references there, for ``most`` of the best."""
        return s["n"].n * 16 <= len(s["n"].of) and q["n"].n * s["n"].n <= 1 << 20 and len(s["n"].of) > 16 * most

    def names(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each name of the queries: cosines of sketches and exact cosines with each name of the references, and the k best references."""
        sketched, exact, best = [], [], []
        for at in range(0, self.name.q.n, 64):
            some = np.arange(at, min(at + 64, self.name.q.n))
            cosines = np.maximum(self.name.products(some), 0)
            sketched.append(cosines)
            i, j = np.divmod(np.arange(cosines.size), cosines.shape[1])
            exact.append(self.name.exact_texts(some, i, j).reshape(cosines.shape))
            best.append(_top(np.take(cosines, self.name.s.of, axis=1), k)[1].reshape(len(some), k))
        return np.concatenate(sketched), np.concatenate(exact), np.concatenate(best)

    def top(self, cosines: np.ndarray, best: np.ndarray, of: np.ndarray, times: np.ndarray, plus: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, reference) as of ``_top`` for the scores max(0, cosines[of]) * times + plus (by part). best: the cosines' maxima by part, 0 at least."""
        most = best[of] * times[:, None] + plus
        low = np.partition(most, self.parts - k, axis=1)[:, self.parts - k]
        low = ((np.maximum(np.rint(low * 1e5), 1) - 0.6) / 1e5).astype(np.float32)
        r, p = np.divmod(np.flatnonzero(most >= low[:, None]), self.parts)
        cells = np.take(cosines.ravel(), (of[r] * cosines.shape[1] + p)[:, None] + np.arange(0, cosines.shape[1], self.parts))
        score = np.maximum(cells, 0) * times[r][:, None] + plus[r, p][:, None]
        x, level = np.divmod(np.flatnonzero(score >= low[r][:, None]), self.depth)
        i, j = r[x], self.ref[level, p[x]]
        value = np.rint(score[x, level] * np.float32(1e5)).astype(np.int64)
        there = (j >= 0) & (value > 0)
        i, j, value = i[there], j[there], value[there]
        few = np.flatnonzero(np.bincount(i, minlength=len(of)) < k)
        if len(few):  # of scores of 0 the first places
            level, part = np.divmod(self.column[:k], self.parts)
            score = np.maximum(cosines[of[few]][:, self.column[:k]], 0) * times[few][:, None] + plus[few][:, part]
            x, more = np.nonzero(np.rint(score * np.float32(1e5)) < 1)
            i, j, value = np.concatenate([i, few[x]]), np.concatenate([j, more]), np.concatenate([value, np.zeros(len(x), np.int64)])
        return _ranked(i, j, value, len(of), k)


def _sketch_search(row: dict, asked: _Asked, sides: dict[str, _Side], dim: int, wide: int, k: tuple[int, int, int]) -> list[np.ndarray]:
    """(question, s1, sn, sa, comb, the reference's address) of the best of a block of references."""
    addresses = np.asarray(row["ss_a_of"], object)
    ids, theirs = np.asarray(row["ss_id"]), {c: _Side(row, f"ss_{c}") for c in "na"}
    if shared := _Shared(sides, theirs, dim) if _Shared.fits(sides, theirs, wide * max(k)) else None:
        name, address, width = shared.name, shared.address, shared.depth * shared.parts
        n_table, n_exact, n_best = shared.names(wide * k[0])
    else:
        name, address, width = *(_Channel(sides[c], theirs[c], dim) for c in "na"), len(ids)
    step = max(1, min(512, (1 << 20) // width, (1 << 24) // (1 + max(len(name.known), len(address.known)))))
    found, order = [], np.argsort(address.order()[asked.address], kind="stable")
    for at in range(0, asked.n, step):
        part = order[at : at + step]
        w, n_text, a_text = asked.w[part], asked.name[part], asked.address[part]
        a_some, a_of = np.unique(a_text, return_inverse=True)
        if shared:
            a_cos = address.products(a_some)
            best = np.maximum(a_cos.reshape(len(a_some), shared.depth, shared.parts).max(axis=1), 0)
            plus = (n_table[n_text] * w.astype(np.float32)[:, None])[:, shared.name_of]
            i, j = shared.top(a_cos, best, a_of, (1 - w).astype(np.float32), plus, wide * k[2])
            pairs = [i * len(ids) + j, (np.arange(len(part))[:, None] * len(ids) + n_best[n_text]).ravel()]
            some = np.arange(len(a_some))
            i, j = shared.top(a_cos, best, some, np.ones(len(some), np.float32), np.zeros_like(best), wide * k[1])
            pairs.append(_for_each(i, j, a_of, len(some), len(ids)))
        else:
            n_some, n_of = np.unique(n_text, return_inverse=True)
            n_cos, a_cos = name.cosines(n_some), address.cosines(a_some)
            blend = np.empty((len(w), len(ids)), np.float32)
            for x in np.unique(w).tolist():
                n_part, a_part = n_cos * np.float32(x), a_cos * np.float32(1 - x)
                for r in np.flatnonzero(w == x).tolist():
                    np.add(n_part[n_of[r]], a_part[a_of[r]], out=blend[r])
            pairs = [np.add(*(x * y for x, y in zip(_top(blend, wide * k[2]), (len(ids), 1), strict=True)))]
            for cosines, of, most in ((n_cos, n_of, k[0]), (a_cos, a_of, k[1])):
                pairs.append(_for_each(*_top(cosines, wide * most), of, len(cosines), len(ids)))
        pairs = np.sort(np.concatenate(pairs))
        i, j = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(ids))
        sn = n_exact[n_text[i], name.s.of[j]] if shared else name.exact(n_some, n_of[i], j)
        sa = address.exact(a_some, a_of[i], j)
        comb = w[i] * sn + (1 - w[i]) * sa
        keep = _first(i, sn, sa, comb, k)
        found.append((part[i[keep]], ids[j[keep]], sn[keep], sa[keep], comb[keep], addresses[j[keep]]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _for_each(i: np.ndarray, j: np.ndarray, of: np.ndarray, rows: int, n: int) -> np.ndarray:
    """row * n + place of the places j of each text i, in the order of the texts, for rows of the texts ``of``."""
    ends = np.cumsum(np.bincount(i, minlength=rows))
    r, at = _spans(np.append(0, ends)[of], ends[of])
    return r * n + j[at]


def gram_frequencies(ref: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> dict[str, DataFrame]:
    """Document frequencies of the grams of both text columns of ``ref``, as tables that ``written`` keeps."""
    return {c: written(document_frequency(gram_counts(ref, ["s1", "country"], c)), f"frequencies_{c}") for c in ("name_key", "addr_clean")}


def retrieve_sketched(
    ref: DataFrame, queries: DataFrame, w_name: float = 0.5, k_name: int = 3, k_addr: int = 3, k_comb: int = 8, dim: int = 1024, block: int = 32768, ref_block: int = 16384, wide: int = 8,
    n: DataFrame | None = None, frequencies: dict[str, DataFrame] | None = None, address_scores: bool = False,
) -> DataFrame:
    """(q, s1, sn, sa, w_name, comb) of each query's best by channel; ties to the smaller s1.

    Blocks of queries meet blocks of references of their country by an equi-join; one task takes a block of queries through all
    references of its country. Within a pair of blocks, the ``wide`` * k best of each channel by cosines of sketches (noise about
    1 / sqrt(dim)) get their exact cosines, and the k best by these go on. Sketches of short texts are mostly zeros, so they are
    multiplied by posting lists of dimensions, and texts that are equal are looked up once. Pairs without any cosine above zero are left out.
    n (n_docs) and ``frequencies``: of all references, where ``ref`` is of some countries only.
    address_scores: with ADDRESS_SCORES of the kept pairs; the texts are at hand here, and each pair of texts is scored once a block.
    """
    n = ref.agg(F.count("*").alias("n_docs")) if n is None else n
    df = frequencies or {}
    weights = {c: store.written(_text_weights(ref, queries, text, n, df.get(text)), f"weights_{text}") for c, text in (("n", "name_key"), ("a", "addr_clean"))}
    # blocks for each country by its own number of records, so that a large country has more of them
    qb = _blocked(queries.withColumn("w_name", blend_weight(w_name)), "q", "qs", block, ["w_name"], weights)
    sb = _blocked(ref, "s1", "ss", ref_block, [], weights)
    parts = int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, min(4 * parts, 256))  # few blocks in each, as they are long tasks
    met = sb.join(qb, "country").repartition(parts, "country", "qs_block").sortWithinPartitions("country", "qs_block", "ss_block")
    k = max(1, k_name), max(1, k_addr), max(2, k_comb)

    def rows(asked: _Asked, texts: list, best: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        i, s1, sn, sa, comb, theirs = best
        columns = {"s1": s1, "sn": sn, "sa": sa, "w_name": asked.w[i], "comb": comb}
        if address_scores:
            at, more = pd.factorize(theirs)
            texts = [*texts, *more.tolist()]
            pairs, back = np.unique(asked.address[i] * len(texts) + len(texts) - len(more) + at, return_inverse=True)
            columns |= {f"ad_{c}": x[back] for c, x in text_scores(texts, *np.divmod(pairs, len(texts))).items()}
        yield from asked.listed(i, columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = best = asked = texts = None
        for frame in frames:
            for row in frame.to_dict("records"):
                if mine != (row["country"], row["qs_block"]):
                    if best:
                        yield from rows(asked, texts, best)
                    mine, best, texts = (row["country"], row["qs_block"]), None, list(row["qs_a_text"])
                    sides = {c: _Side(row, f"qs_{c}") for c in "na"}
                    asked = _Asked(row, sides["n"], sides["a"])
                found = _sketch_search(row, asked, sides, dim, wide, k)
                if best:
                    found = [np.concatenate(x) for x in zip(best, found, strict=True)]
                    order = np.lexsort((np.unique(found[1], return_inverse=True)[1], found[0]))
                    found = [x[order] for x in found]
                    keep = _first(found[0], *found[2:5], k)
                    found = [x[keep] for x in found]
                best = found
        if best:
            yield from rows(asked, texts, best)

    kinds = dict(queries.dtypes)["q"], dict(ref.dtypes)["s1"]
    scores = "".join(f", {c} double" for c in ADDRESS_SCORES) if address_scores else ""
    return met.mapInPandas(run, f"q {kinds[0]}, s1 {kinds[1]}, sn double, sa double, w_name double, comb double{scores}")
