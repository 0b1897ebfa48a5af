"""Numbers from 0 in a given order, without a task that sorts all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numbered(rows: DataFrame, name: str, order: list[str], written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``rows`` with ``name``, a long from 0 by ``order``; rows that are equal in it are numbered in any order.

    Ranges of the order are written once by ``written`` with the number of their range, and both the counts
    of the ranges and the numbers are read from that table: a plan that ran twice could cut other ranges.
    """
    split = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = split.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    number = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return split.join(F.broadcast(before), "_part").withColumn(name, number.cast("long")).drop("_part", "_before")
