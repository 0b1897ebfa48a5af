"""Best-fit packing into bins of several permitted sizes.

Documents longer than the largest size are cut into pieces of it, between characters. Pieces are dealt by a hash into groups
of about ``group_pieces``, a number that doesn't depend on the input's size; each group is packed by
best-fit decreasing: a piece goes to the open bin with the least room that holds it. If none does, a
bin is opened, of the size with the least cost a token: the cost of that size over what can still fill it,
which is the piece and the shorter pieces left that fit beside it. At the end each bin is downsized to
the smallest size that holds its contents. ``pack`` gives each piece its place, ``sequences`` the bins' texts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: Copies of equal rows that go to one group together.
_CHUNK = 256


def size_cost(size: int, overhead: int, quadratic: int) -> float:
    """Cost of a sequence: a fixed part, a linear one, and a quadratic one that equals the linear at ``quadratic`` tokens."""
    return overhead + size + size * size / quadratic


def best_fit(lengths: list[int], sizes: list[int], overhead: int, quadratic: int) -> tuple[list[int], list[int]]:
    """(bin of each piece, final size of each bin) for piece lengths in falling order, 1 to the largest size."""
    sizes = sorted(sizes)
    cost = {s: size_cost(s, overhead, quadratic) for s in sizes}
    left = np.concatenate((np.cumsum(lengths[::-1])[::-1], [0])).tolist() if lengths else [0]
    rising = [-x for x in lengths]
    open_: dict[int, list[int]] = {}
    mask = 0  # bit r: a bin with room r is open
    bins, filled = [], []
    for i, length in enumerate(lengths):
        fitting = mask >> length
        if fitting:
            room = length + ((fitting & -fitting).bit_length() - 1)
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
            filled[b] += length
        else:
            def unit(s: int, length: int = length, i: int = i) -> tuple[float, int]:
                gap = s - length
                rest = left[max(i + 1, bisect.bisect_left(rising, -gap))] if gap else 0
                return cost[s] / (length + min(gap, rest)), s

            size = min((s for s in sizes if s >= length), key=unit)
            b, room = len(filled), size
            filled.append(length)
        bins.append(b)
        if room > length:
            open_.setdefault(room - length, []).append(b)
            mask |= 1 << (room - length)
    return bins, [sizes[bisect.bisect_left(sizes, n)] for n in filled]


def piece_starts(raw: bytes, most: int) -> list[int]:
    """First bytes of the pieces of a UTF-8 text: each is as long as ``most`` bytes and the character at its end let it be."""
    out = [0]
    while out[-1] + most < len(raw):
        at = out[-1] + most
        while raw[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return out


def _cut_rows(docs: DataFrame, most: int, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """(id, n, h, starts, text?): UTF-8 length and hash of each text, and where its pieces start, null for [0]. Only long texts go through Python."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n"), F.xxhash64(text).alias("h"), text.alias("text"))
    columns = ["id", "n", "h", "starts", *(["text"] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                starts = pa.array([piece_starts(part.column(3)[0].as_py().encode("utf-8"), most)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], starts, *([part.column(3)] if keep_text else [])], names=columns)

    short = rows.where(F.col("n") <= most).withColumn("starts", F.lit(None).cast("array<bigint>")).select(*columns)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n long, h long, starts array<bigint>" + (", text string" if keep_text else "")
    return short.unionByName(rows.where(F.col("n") > most).mapInArrow(run, schema))


def pack(
    docs: DataFrame,
    sizes: tuple[int, ...] = (4096, 8192, 16384, 32768),
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 256,
    quadratic: int = 65536,
    group_pieces: int = 20_000,
) -> DataFrame:
    """A row for each piece: ``id_col``, doc_bytes, text_hash, copy, piece, start, length, bin, bin_size, position.

    Tokens are UTF-8 bytes; start is the piece's first byte in the text, position its place in the bin. Sizes are
    4 bytes at least, so that any character fits. Null and empty texts are in no bin: piece 0 of length 0, bin and
    position null, bin_size 0. Rows with equal id, length and text hash are numbered by copy from 0 and packed
    each. A null id is an id like any other. An empty table gives an empty result. Other columns are not read.
    """
    most = max(sizes)
    if min(sizes) < 4:
        raise ValueError("sizes are 4 bytes at least")
    rows = _cut_rows(docs, most, id_col, text_col, keep_text=False)
    rows = common.cut(rows.groupBy("id", "n", "h", "starts").agg(F.count("*").alias("c")), "lengths")
    pieces = rows.agg(F.coalesce(F.sum(F.col("c") * F.coalesce(F.size("starts"), F.lit(1))), F.lit(0))).first()[0]
    groups = max(1, -(-pieces // group_pieces))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / _CHUNK))).alias("chunk")
    dealt = rows.select("id", "n", "h", "starts", "c", chunk)
    id_type = rows.schema["id"].dataType.simpleString()  # pandas would turn integers with nulls into floats
    first, copies = F.col("chunk") * _CHUNK, F.least(F.lit(_CHUNK), F.col("c") - F.col("chunk") * _CHUNK)
    dealt = dealt.select(F.col("id").cast("string"), "n", "h", "starts", first.alias("first"), copies.alias("copies"), F.pmod(F.xxhash64("id", "n", "h", "chunk"), F.lit(groups)).alias("group"))

    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.loc[got.index.repeat(got["copies"])].reset_index(drop=True)
        got["copy"] = got["first"] + got.groupby(["id", "n", "h", "first"], dropna=False).cumcount()
        starts = [[0] if s is None else list(s) for s in got["starts"]]
        got = got.loc[got.index.repeat([len(s) for s in starts])]
        got["piece"] = got.groupby(level=0).cumcount()
        got["start"] = [x for s in starts for x in s]
        got["length"] = [b - a for s, n in zip(starts, got.groupby(level=0)["n"].first(), strict=True) for a, b in zip(s, [*s[1:], n], strict=True)]
        got = got.sort_values(["length", "id", "n", "h", "copy", "piece"], ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)
        full = int((got["length"] > 0).sum())
        bins, final = best_fit(got["length"].tolist()[:full], list(sizes), overhead, quadratic)
        local = pd.Series([*bins, *[None] * (len(got) - full)], dtype="Int64")
        got["bin"] = local + (int(key[0]) << 32)
        got["bin_size"] = [final[b] for b in bins] + [0] * (len(got) - full)
        got["position"] = local.groupby(local).cumcount().where(local.notna()).astype("Int64")
        return got[["id", "n", "h", "copy", "piece", "start", "length", "bin", "bin_size", "position"]]

    packed = dealt.groupBy("group").applyInPandas(run, "id string, n long, h long, copy long, piece long, start long, length long, bin long, bin_size long, position long")
    return packed.withColumn("id", F.col("id").cast(id_type)).withColumnsRenamed({"id": id_col, "n": "doc_bytes", "h": "text_hash"})


def sequences(docs: DataFrame, packed: DataFrame, sizes: tuple[int, ...] = (4096, 8192, 16384, 32768), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each bin of ``pack(docs, sizes)``: bin, bin_size, n_bytes, ids, offsets and text, the pieces' texts one after the other.

    ids and offsets (first bytes in text) are in the order of the pieces. Texts are cut into pieces before they are
    shuffled, and a bin holds no more than the largest size.
    """
    rows = _cut_rows(docs, max(sizes), id_col, text_col, keep_text=True).where("n > 0").dropDuplicates(["id", "n", "h"])
    starts = F.coalesce("starts", F.array(F.lit(0).cast("long")))
    parts = rows.select("id", "n", "h", F.col("text").cast("binary").alias("raw"), F.posexplode(starts).alias("piece", "start"), starts.alias("starts"))
    end = F.coalesce(F.get("starts", F.col("piece") + 1), F.col("n"))
    parts = parts.select("id", "n", "h", "piece", F.substring("raw", (F.col("start") + 1).cast("int"), (end - F.col("start")).cast("int")).cast("string").alias("content"))
    placed = packed.where("bin is not null").withColumnRenamed(id_col, "__id")
    same = placed["__id"].eqNullSafe(parts["id"]) & (placed["doc_bytes"] == parts["n"]) & (placed["text_hash"] == parts["h"]) & (placed["piece"] == parts["piece"])
    offset = F.sum("length").over(W.partitionBy("bin").orderBy("position")) - F.col("length")
    entry = F.struct("position", "offset", "id", "content")
    listed = placed.join(parts, same).drop(parts["piece"]).withColumn("offset", offset).groupBy("bin", "bin_size").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    text = F.array_join("s.content", "")
    return listed.select("bin", "bin_size", F.octet_length(text).cast("long").alias("n_bytes"), F.col("s.id").alias("ids"), F.col("s.offset").alias("offsets"), text.alias("text"))
