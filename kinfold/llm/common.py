"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a character class body: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a table that is broadcast by hint; beyond it a shuffled join is used.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: later jobs start from that table.

    The files outlive any executor, and go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(min(int(before), 1024)))  # texts and hash sets are wide rows
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_folder = str(where)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() has written, once nothing reads them any more: what was made of them is written itself."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kinfold_folder)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a check of the counted size."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: A key is hot if it has one row of so many; there can't be more hot keys than this.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join of two written tables, of which ``counted`` has each of the keys once, with n, the number of its rows.

    Keys with more than 1 / HOT_KEYS of all counted rows, at most HOT_KEYS, are broadcast; the others have few rows each and are shuffled.
    """
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counted.where(F.col("n") * HOT_KEYS > total).drop("n")
    cold = counted.where(F.col("n") * HOT_KEYS <= total).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components by minimum labels and pointer jumping.

    nodes: (node); edges: (a, b), any direction, repeats allowed. Returns (node, label) with the
    smallest node of each component. Each round is an aggregate with map-side combining and two
    equi-joins, written to the shared folder; nothing is gathered on the driver but a flag.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        # the label's own node hears of the smaller label as well, so that trees merge as wholes
        offers = labels.join(near, "node").where("near < label")
        offers = (
            offers.select("node", "near")
            .unionByName(offers.select(F.col("label").alias("node"), "near"))
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        hooked = cut(
            labels.join(offers, "node", "left").select(
                "node", F.least("label", F.coalesce("near", "label")).alias("new"), (F.coalesce("near", "label") < F.col("label")).alias("moved")
            ),
            "hooked",
        )
        if hooked.where("moved").isEmpty():
            drop(both, hooked)
            return labels
        before, labels = labels, cut(
            hooked.join(hooked.select(F.col("node").alias("new"), F.col("new").alias("up")), "new", "left").select(
                "node", F.least("new", F.coalesce("up", "new")).alias("label")
            ),
            "labels",
        )
        drop(before, hooked)
