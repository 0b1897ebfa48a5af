"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to one of ``ring`` places; each shard has many virtual nodes at hashed places, and a key's
owner is the first virtual node clockwise. A shard takes no more than its bound. First each shard takes
its own keys, place by place from the ring's start, up to its bound; then what overflows at a place
continues clockwise to the first virtual node of a shard with room. Bounds are floor(rows / shards), one
more for the shards with the most own keys where rows don't divide: so counts are at most one apart.

The walk needs counts by place only: a table of ``ring`` rows at most, whatever the number of rows.
A row's part of the walk follows from its rank within its place.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


def virtual_nodes(shards: int, per_shard: int, ring: int) -> list[tuple[int, int]]:
    """(place, shard), sorted. A new shard adds nodes and leaves those of the others where they are."""
    taken: dict[int, int] = {}
    for v in range(per_shard):
        for s in range(shards):
            place = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % ring
            while place in taken:
                place = (place + 1) % ring
            taken[place] = s
    return sorted(taken.items())


def bounded_walk(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, last rank + 1, shard, first slot) of runs of each place's keys. counts: keys by place."""
    total = sum(counts.values())
    places = [p for p, _ in nodes]
    owner = {p: nodes[bisect.bisect_left(places, p) % len(nodes)] for p in counts}
    own = [0] * shards
    for p, n in counts.items():
        own[owner[p][1]] += n
    most = sorted(range(shards), key=lambda s: (-own[s], s))
    room = [total // shards] * shards
    for s in most[: total % shards]:
        room[s] += 1
    filled, runs, over = [0] * shards, [], []
    for p in sorted(counts):
        s = owner[p][1]
        n = min(counts[p], room[s] - filled[s])
        if n:
            runs.append((p, 0, n, s, filled[s]))
            filled[s] += n
        if n < counts[p]:
            over.append((p, n))
    for p, at in over:
        i = bisect.bisect_left(places, p)
        while at < counts[p]:
            s = nodes[i % len(nodes)][1]
            n = min(counts[p] - at, room[s] - filled[s])
            if n:
                runs.append((p, at, at + n, s, filled[s]))
                filled[s], at = filled[s] + n, at + n
            i += 1
    return runs


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", tie_cols: tuple[str, ...] = (), per_shard: int = 128, ring: int = 1 << 16, salts: int = 16) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 within a shard) to ``docs``, replacing these columns.

    Ranks within a place go by salt, then hash, id and ``tie_cols``: where many rows have one id, the salt,
    a hash of the id and ``tie_cols``, splits them. Rows equal in all these are interchangeable. A null id
    is an id like any other; an empty table gives an empty result. Placement depends on the rows alone,
    not on partitions. Other columns are kept.
    """
    spark = docs.sparkSession
    ties = [F.col(id_col), *(F.col(c) for c in tie_cols)]
    h = F.xxhash64(F.col(id_col))
    keyed = docs.drop("shard", "slot").withColumns({"__place": F.pmod(h, F.lit(ring)).cast("int"), "__h": h, "__salt": F.pmod(F.hash(*ties), F.lit(salts))})
    keyed = common.cut(keyed, "keyed")
    split = common.cut(keyed.groupBy("__place", "__salt").agg(F.count("*").alias("n")), "places")
    counts = {r["__place"]: r["n"] for r in split.groupBy("__place").agg(F.sum("n").alias("n")).collect()}  # ring rows at most
    runs = bounded_walk(counts, virtual_nodes(shards, per_shard, ring), shards)
    table = spark.createDataFrame(runs, "__place int, lo long, hi long, shard int, start long")
    table = table.groupBy("__place").agg(F.collect_list(F.struct("lo", "hi", "shard", "start")).alias("__runs"))
    offsets = split.withColumn("__before", F.sum("n").over(W.partitionBy("__place").orderBy("__salt")) - F.col("n")).drop("n")
    offsets = offsets.join(F.broadcast(table), "__place")  # ring rows at most
    rank = F.row_number().over(W.partitionBy("__place", "__salt").orderBy("__h", *ties)) - 1
    placed = keyed.withColumn("__rank", rank).join(offsets, ["__place", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    run = F.get(F.filter("__runs", lambda r: (r["lo"] <= F.col("__rank")) & (F.col("__rank") < r["hi"])), F.lit(0))
    placed = placed.withColumn("__run", run)
    out = [F.col(c) for c in keyed.columns if c not in ("__place", "__h", "__salt")]
    return placed.select(*out, F.col("__run.shard").alias("shard"), (F.col("__run.start") + F.col("__rank") - F.col("__run.lo")).alias("slot"))
