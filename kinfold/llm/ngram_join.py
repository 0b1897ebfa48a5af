"""N-gram Jaccard self-join by vertical partitioning.

A document's set is its distinct word n-grams, held as 64-bit hashes; the hash order is the global
order of the n-grams and is cut into fragments of equal width. Overlaps are counted in each
fragment on its own and summed:

1. *Pruning fragments.* For a document x that links at Jaccard t, at most (1 - t)|x| of its n-grams
   are missing from the partner, wherever they lie. So over any range A of the order, at least
   |x_A| - (1 - t)|x| of its n-grams there occur in another set. Documents below that cannot link
   and leave. First A is a part of the order, then, for those left, all of it.
2. *Candidates.* N-grams of what is left are ordered by document frequency. By the prefix filter, two
   sets that link share an n-gram among the first of each, and the places of that n-gram in both orders
   bound the partner's size on either side: the smaller set's prefix is the shorter one. Each posting
   list is first compared with its leader only; sets that are then in one component are not compared any
   more, so a group of near copies costs rows in proportion to its size.
3. *Verification.* For each pair, partial overlaps are counted in each fragment and summed. Pairs that
   are left after the leaders come from the posting lists, long ones cut into blocks.

Equal sets form one class before all this, by a 128-bit digest; a class is named by the digest's first half,
and by another hash where two classes share that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 18
#: Bytes of words that are hashed 8 at a time, all words together; longer words by themselves.
_LONG = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: For the last 1 to 8 bytes of a word: which of 8 loaded ones belong to it.
_MASKS = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes_of_words(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the first byte's place for each word of these bytes, 8 bytes of all words at a time."""
    edges = np.diff(np.concatenate(([0], (~_SEPARATOR[piece]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    loaded = np.lib.stride_tricks.sliding_window_view(np.concatenate((piece, np.zeros(8, np.uint8))), 8)
    sizes = ends - starts
    out, left, done = sizes.astype(np.uint64) * _ODD, np.arange(len(starts)), 0
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = np.frombuffer(hashlib.blake2b(piece[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    left = np.flatnonzero(sizes <= _LONG)
    while len(left):
        rest = sizes[left] - done
        eight = loaded[starts[left] + done].view("<u8")[:, 0] & _MASKS[np.minimum(rest, 8)]
        out[left] = _mix((out[left] ^ eight) * _ODD)
        left, done = left[rest > 8], done + 8
    return out, starts


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, in order. Long texts go by pieces cut between words."""
    raw = np.frombuffer(_lowered(text), np.uint8)
    if len(raw) <= _CHUNK:
        return _hashes_of_words(raw)[0]
    out, at = [], 0
    while at < len(raw):
        end, span = len(raw), _CHUNK
        while at + span < len(raw):
            gaps = np.flatnonzero(_SEPARATOR[raw[at : at + span]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            span *= 2
        out.append(_hashes_of_words(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, 1000003 * size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : n + k])
    return out


def _distinct(hashes: np.ndarray) -> np.ndarray:
    out = np.sort(hashes)
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run as a whole."""
    words = word_hashes(text or "")
    return _distinct(_runs(words, min(size, len(words)))) if len(words) else words


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """shingle_set of each text; texts up to _CHUNK bytes are hashed many at a time."""
    at = 0
    while at < len(texts):
        raws, total = [], 0
        while at + len(raws) < len(texts) and total <= _CHUNK:
            raws.append(_lowered(texts[at + len(raws)]))
            total += len(raws[-1]) + 1
        if total > 2 * _CHUNK:  # the last is a long one
            raws.pop()
        words, starts = _hashes_of_words(np.frombuffer(b" ".join(raws), np.uint8))
        first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])).tolist()
        runs = _runs(words, size)
        for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
            yield _distinct(runs[a : b - size + 1]) if b - a >= size else shingle_set(texts[at + i], size)
        at += len(raws)
        if not raws:
            yield shingle_set(texts[at], size)
            at += 1


def _digest(s: np.ndarray) -> tuple[int, int]:
    digest = hashlib.md5(s.tobytes()).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


_SETS = "id {id}, n long, node long, tail long, part binary, rest binary"


def _sets(size: int, top: int):
    """A batch of (id, text) to _SETS: node and tail are the set's digest, part holds the hashes up to ``top`` and rest the others, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, texts = batch.column(0).slice(at, 128), batch.column(1).slice(at, 128)
                n, nodes, tails, low, high = [], [], [], [], []
                for s in shingle_sets(texts.to_pylist(), size):
                    digest = _digest(s) if len(s) else (None, None)
                    cut = np.searchsorted(s, np.uint64(top), "right")
                    for column, value in zip((n, nodes, tails, low, high), (len(s), *digest, s[:cut].tobytes(), s[cut:].tobytes()), strict=True):
                        column.append(value)
                longs = (pa.array(x, pa.int64()) for x in (n, nodes, tails))
                yield pa.RecordBatch.from_arrays([ids, *longs, pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=["id", "n", "node", "tail", "part", "rest"])

    return run


def _named_apart(rows: DataFrame) -> DataFrame:
    """_SETS with a name (node) for each digest that no other has: names that two share are hashed anew."""
    salt = 0
    while True:
        shared = rows.where("n > 0").groupBy("node").agg(F.min("tail").alias("a"), F.max("tail").alias("b")).where("a < b").select("node")
        shared = common.cut(shared, "shared")
        if shared.isEmpty():
            return rows
        salt += 1
        other = F.when(F.col("again"), F.xxhash64(F.lit(salt), "node", "tail")).otherwise(F.col("node"))
        renamed = common.cut(rows.join(shared.withColumn("again", F.lit(True)), "node", "left").withColumn("node", other).drop("again"), "renamed")
        common.drop(rows)
        rows = renamed


_PACKED = "place int, kind int, ids binary, a binary, b binary"


def _spread(fragments: int, top: int, flush_hashes: int = 400_000):
    """(node, n, part) to packed rows. Kind 0: hashes of a fragment, with the one node here that has
    each (or a mark, if several here have it). Kind 1: n, size of the part, and how many of the
    part's hashes are shared within this flush, by node."""

    width = top // fragments + 1

    def packed(seen: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        nodes = np.array(list(seen), np.int64)
        sizes = np.array([len(p) for _, p in seen.values()], np.int64)
        every = np.concatenate([p for _, p in seen.values()]) if len(nodes) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        several = np.diff(np.append(starts, len(every))) > 1
        shared = np.bincount(owner[np.repeat(several, np.diff(np.append(starts, len(every))))], minlength=len(nodes))
        hashes, owners = every[starts], np.where(several, -1, owner[starts].astype(np.int64))
        places, kinds, ids, a, b = [], [], [], [], []
        at = np.searchsorted(hashes, np.array([min(f * width, 2**64 - 1) for f in range(1, fragments)], np.uint64))
        for f, (h, o) in enumerate(zip(np.split(hashes, at), np.split(owners, at), strict=True)):
            if len(h):
                table, index = np.unique(o, return_inverse=True)
                known = np.where(table < 0, 0, nodes[np.maximum(table, 0)])
                places.append(f)
                kinds.append(0)
                # the mark is kept as a first entry of the table that no node has
                ids.append((b"\1" if len(table) and table[0] < 0 else b"\0") + known.astype(np.int64).tobytes())
                a.append(h.tobytes())
                b.append(index.astype(np.uint32).tobytes() if len(table) > 65535 else index.astype(np.uint16).tobytes())
        total = np.array([n for n, _ in seen.values()], np.int64)
        bucket = (nodes.view(np.uint64) % np.uint64(fragments)).astype(np.int64)
        for f in np.unique(bucket):
            mine = bucket == f
            places.append(int(f))
            kinds.append(1)
            ids.append(nodes[mine].tobytes())
            a.append(np.stack((total[mine], sizes[mine])).tobytes())
            b.append(shared[mine].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array(kinds, pa.int32()), *(pa.array(x, pa.binary()) for x in (ids, a, b))], names=["place", "kind", "ids", "a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, np.ndarray]] = {}
        held = 0
        for batch in batches:
            for node, n, part in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if (key := node.as_py()) in seen:
                    continue
                seen[key] = (n.as_py(), hashes := np.frombuffer(part.as_py(), np.uint64))
                held += len(hashes)
                if held >= flush_hashes or len(seen) >= 30_000:
                    yield from packed(seen)
                    seen, held = {}, 0
        if seen:
            yield from packed(seen)

    return run


def _count_fragment(fragments: int):
    """One fragment's packed rows: which hashes occur with two nodes; their nodes get counts, packed by bucket. Rows of kind 1 pass through."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        through, table = table.filter(pc.equal(table["kind"], 1)), table.filter(pc.equal(table["kind"], 0))
        if not table.num_rows:
            return through
        hashes, nodes, several = [], [], []
        for ids, a, b in zip(*(table.column(c) for c in ("ids", "a", "b")), strict=True):
            ids, b = ids.as_buffer(), b.as_buffer()
            h = np.frombuffer(a.as_buffer(), np.uint64)
            index = np.frombuffer(b, np.uint16 if b.size == 2 * len(h) else np.uint32)
            hashes.append(h)
            nodes.append(np.frombuffer(ids, np.int64, offset=1)[index])
            several.append((index == 0) if np.frombuffer(ids, np.uint8, 1)[0] else np.zeros(len(h), bool))
        h, node, many = map(np.concatenate, (hashes, nodes, several))
        del hashes, nodes, several
        order = np.argsort(h, kind="stable")
        h, node, many = h[order], node[order], many[order]
        del order
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        lengths = np.diff(np.append(starts, len(h)))
        # two nodes, or one mark, make a hash shared; the same node from two flushes doesn't
        top, low = np.maximum.reduceat(node, starts), np.minimum.reduceat(node, starts)
        shared = np.repeat(((lengths > 1) & (top != low)) | np.logical_or.reduceat(many, starts), lengths) & ~many
        h, node = h[shared], node[shared]
        order = np.lexsort((h, node))  # a node that came in two flushes counts once for a hash
        h, node = h[order], node[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1]))) if len(h) else np.zeros(0, bool)
        got, count = np.unique(node[fresh], return_counts=True)
        bucket = (got.view(np.uint64) % np.uint64(fragments)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        places, at = np.unique(bucket[order], return_index=True)
        pieces = [np.split(x[order], at[1:]) if len(at) else [] for x in (got, count.astype(np.int64))]
        ids, b = ([x.tobytes() for x in p] for p in pieces)
        made = pa.table([pa.array(places, pa.int32()), pa.array([2] * len(places), pa.int32()), *(pa.array(x, pa.binary()) for x in (ids, [b""] * len(places), b))], names=table.column_names)
        return pa.concat_tables([through.cast(made.schema), made])

    return run


def _keep_bucket(num: int, den: int):
    """Sums the counts of a bucket's nodes over the fragments and keeps those that can link."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        nodes, totals, sizes, counts = [], [], [], []
        for kind, ids, a, b in zip(*(table.column(c) for c in ("kind", "ids", "a", "b")), strict=True):
            found = np.frombuffer(ids.as_buffer(), np.int64)
            n, size = np.frombuffer(a.as_buffer(), np.int64).reshape(2, -1) if kind.as_py() == 1 else np.zeros((2, len(found)), np.int64)
            for column, value in zip((nodes, totals, sizes, counts), (found, n, size, np.frombuffer(b.as_buffer(), np.int64)), strict=True):
                column.append(value)
        every, at = np.unique(np.concatenate(nodes), return_inverse=True)
        count = np.zeros(len(every), np.int64)
        np.add.at(count, at, np.concatenate(counts))
        n, size = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        np.maximum.at(n, at, np.concatenate(totals))
        np.maximum.at(size, at, np.concatenate(sizes))
        # count over-states for a node that came in several flushes, which keeps it: the bound stays safe
        keep = den * (size - count) <= (den - num) * n
        return pa.table([pa.array(every[keep]), pa.array(n[keep])], names=["node", "n"])

    return run


def _shared_enough(parts: DataFrame, top: int, total: int, num: int, den: int, fragment_hashes: int = 500_000) -> DataFrame:
    """Nodes of (node, n, part) of whose part enough is shared with other nodes. Pruning step 1."""
    fragments = max(1, -(-total // fragment_hashes))
    packed = parts.select("node", "n", "part").mapInArrow(_spread(fragments, top), _PACKED)
    counted = packed.groupBy("place").applyInArrow(_count_fragment(fragments), _PACKED)
    return counted.groupBy("place").applyInArrow(_keep_bucket(num, den), "node long, n long")


def _segments(fragments: int):
    """(node, part) to (node, frags): the hashes of each fragment of the order, as an array of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2**64 // fragments
        cuts = np.array([f * width for f in range(1, fragments)], np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                nodes, arrays = batch.column(0).slice(at, 256), [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1).slice(at, 256)]
                inner = [np.concatenate(([0], np.searchsorted(h, cuts), [len(h)])) for h in arrays]
                sizes = np.concatenate([np.diff(x) for x in inner])
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64)))
                outer = pa.array(np.arange(len(arrays) + 1, dtype=np.int32) * fragments)
                yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(outer, lists)], names=["node", "frags"])

    return run


def _links_here(num: int, den: int) -> Column:
    """Whether a pair (fa, fb, na, nb) links: overlaps counted fragment by fragment, and summed."""
    partial = F.zip_with("fa", "fb", lambda x, y: F.size(F.array_intersect(x, y)))
    return (num + den) * F.aggregate(partial, F.lit(0), lambda x, y: x + y) >= num * (F.col("na") + F.col("nb"))


def _able(num: int, den: int) -> Column:
    """Whether a pair (na, ma, la, nb, mb, lb) can link by its sizes, and isn't in one component yet."""
    near = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    return near & (F.col("nb") <= F.col("ma")) & (F.col("na") <= F.col("mb")) & (F.col("la") != F.col("lb"))


def _named(df: DataFrame, x: str, *more: str) -> DataFrame:
    """(node, n, most, label, ...) as one side of a pair."""
    return df.select(*more, *(F.col(c).alias(f"{p}{x}") for c, p in (("node", ""), ("n", "n"), ("most", "m"), ("label", "l"))))


def _open(postings: DataFrame, by_label: bool) -> DataFrame:
    """Postings (gram, node, n, most, share, label) of lists with pairs across components, without nodes that no partner there is small enough for."""
    least = postings.groupBy("gram").agg(F.min("n").alias("least"))
    fit = postings.join(least, "gram").where("most >= least").drop("least")
    several = F.min("label") < F.max("label") if by_label else F.count("*") > 1
    return fit.join(fit.groupBy("gram").agg(several.alias("several")).where("several").select("gram"), "gram")


def _linked(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """(la, lb) of those pairs (a, na, ma, la, b, ...) that link, each judged once; ``pairs`` is left as a table."""
    pairs = common.cut(pairs.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("na", "nb", "la", "lb"))), "pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    own = segments.join(needed, "node", "left_semi")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("frags").alias("fa")), "a").join(own.select(F.col("node").alias("b"), F.col("frags").alias("fb")), "b")
    return both.where(_links_here(num, den)).select("la", "lb")


def _pairs_with_leaders(held: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each posting list's leader and its other sets."""
    return _named(held, "b", "gram").join(_named(first, "a", "gram"), "gram").where((F.col("a") != F.col("b")) & _able(num, den))


def _pairs_of_lists(held: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """All pairs of posting lists that can link and aren't in one component. A list is cut into blocks of about ``block``, which meet each other."""
    blocks = held.groupBy("gram").agg(F.ceil(F.count("*") / block).alias("blocks"))
    rows = held.join(blocks, "gram")
    left = _named(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "a", "gram", "block")
    right = _named(rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))), "b", F.col("gram").alias("g"), F.col("block").alias("k"))
    met = (F.col("gram") == F.col("g")) & (F.col("block") == F.col("k")) & (F.col("a") < F.col("b")) & _able(num, den)
    return left.join(right, met)


def _links(prefixes: DataFrame, segments: DataFrame, nodes: DataFrame, num: int, den: int, leader_rounds: int, block: int) -> DataFrame:
    """(node, label) after all pairs that share a prefix n-gram and aren't in one component were compared.

    ``most`` is the largest size of a partner with which the n-grams from this one on can suffice. First, round
    by round, each posting list is compared with its leader, the set that shares the largest part of its
    n-grams, which then leaves the list, and components are joined: near copies of one text, most of
    whose lists have one leader, become one component at a cost in proportion to their postings. Then all pairs left across components are compared.
    """
    postings, labels = prefixes.withColumn("label", F.col("node")), nodes.select("node", F.col("node").alias("label"))
    for step in range(leader_rounds + 1):
        held = common.cut(_open(postings, step > 0), "postings")
        if held.isEmpty():
            return labels
        # an aggregate combines before the shuffle
        first = held.groupBy("gram").agg(F.max(F.struct("share", "node", "n", "most", "label")).alias("s")).select("gram", "s.*")
        pairs = _pairs_with_leaders(held, first, num, den) if step < leader_rounds else _pairs_of_lists(held, num, den, block)
        edges = common.cut(_linked(pairs, segments, num, den).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
        if not edges.isEmpty():
            merged = common.components(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), edges)
            merged = merged.select(F.col("node").alias("label"), F.col("label").alias("now"))
            labels = common.cut(labels.join(merged, "label", "left").select("node", F.coalesce("now", "label").alias("label")), "labels")
        if step < leader_rounds:
            rest = held.join(first.select("gram", "node"), ["gram", "node"], "left_anti")
            postings = rest.drop("label").join(labels, "node")
    return labels


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75, den: int = 100, share: float = 0.4, fragments: int = 8, leader_rounds: int = 1, block: int = 4096
) -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of at least ``num / den``.

    Returns (``id_col``, n_shingles, component_id), a row for each row of ``docs``; component_id is the
    smallest id reachable by links, itself included. ``share``: the part of the n-gram order that the
    first pruning looks at. ``leader_rounds`` and
    ``block``: see _links; they change the work, not the result.

    Null or empty texts, or texts without words: n_shingles 0, linked with nothing. Fewer words than
    ``size``: the whole sequence is the only n-gram. Rows with equal sets are in one component, repeated
    rows too; a null id is no candidate for component_id, but its text links others, and only components of
    null ids alone have a null component_id. An empty table gives an empty result. Other
    columns of ``docs`` are not read, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    top = int(share * 2**64)
    rows = _named_apart(common.cut(base.mapInArrow(_sets(size, top), _SETS.format(id=id_type)), "sets"))
    names = common.cut(rows.select("id", "n", "node"), "names")
    full = rows.where("n > 0")
    total = full.agg(F.coalesce(F.sum(F.length("part")), F.lit(0))).first()[0] // 8
    able = common.cut(_shared_enough(full, top, total, num, den), "able")
    sets = full.join(common.maybe_broadcast(able.select("node"), able.count()), "node", "left_semi")
    whole = common.cut(sets.select("node", "n", F.concat("part", "rest").alias("part")).dropDuplicates(["node"]), "whole")
    common.drop(rows, able)
    total = whole.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    live = common.cut(_shared_enough(whole, 2**64 - 1, total, num, den), "live")
    segments = common.cut(whole.join(live.select("node"), "node", "left_semi").select("node", "part").mapInArrow(_segments(fragments), "node long, frags array<array<bigint>>"), "segments")
    common.drop(whole)
    postings = segments.select("node", F.explode(F.flatten("frags")).alias("gram")).join(live, "node")
    df = postings.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(df, "gram").withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("df", "gram"))).withColumn("shared", F.count("*").over(W.partitionBy("node")))
    # n-grams of one document are the rarest and come first in the order
    left = F.col("shared") - F.col("k") + 1
    most = F.floor(left * (num + den) / num).cast("long") - F.col("n")
    prefixes = common.cut(shared.where(den * left >= num * F.col("n")).select("gram", "node", "n", most.alias("most"), (F.col("shared") / F.col("n")).alias("share")), "prefixes")
    labels = _links(prefixes, segments, live.select("node"), num, den, leader_rounds, block)
    common.drop(prefixes, segments)
    classes = names.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"))
    named = labels.join(classes, "node").select("label", "node", "rep")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = classes.join(named.join(smallest, "label").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return (
        names.join(of_class, "node", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    )
