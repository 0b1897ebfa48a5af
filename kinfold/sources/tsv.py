"""Tab-separated tables without quoting, all strings, where an empty field is a value; and grouped id lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
#: The files of a split.
SPLIT_FILES = {
    "train": {"s1": "train_source1.tsv", "s2": "train_source2.tsv", "s3": "train_source3.tsv", "gt": "train_ground_truth.tsv"},
    "test": {"s1": "test_source1.tsv", "s2": "test_source2.tsv", "s3": "test_source3.tsv"},
}
#: Columns that give a row's place in its file.
PLACE = ["_file", "_block", "_row"]
_RAW = {"sep": "\t", "quote": "\u0000", "escape": "\u0000", "header": True, "mode": "PERMISSIVE", "encoding": "UTF-8"}


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return [c.strip() for c in first[0][0].split("\t")] if first else []


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a TSV by its stripped header names; nothing is null."""
    names = _header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.options(**_RAW, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).schema(schema).csv(path).fillna("")


def read_source(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """The record columns; with ``place`` also PLACE: the file, the block of it and the row's number in that block, which orders rows as the file does."""
    if not place:
        return read_table(spark, path).select(*RECORD_COLUMNS)
    at = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return read_table(spark, path).select(*RECORD_COLUMNS, *(c.alias(n) for c, n in zip(at, PLACE, strict=True)))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): distinct trimmed first fields, without the header and blank lines."""
    lines = spark.read.text(path)
    first = spark.read.text(path).limit(1).collect()
    out = lines.where(F.trim("value") != "").select(F.trim(F.split("value", "\t", 2)[0]).alias("id"))
    return out.where(F.col("id") != (first[0][0].split("\t")[0].strip() if first else "")).distinct()


def write_table(df: DataFrame, path: str) -> None:
    """A TSV folder; empty strings stay truly empty."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").options(
        sep="\t", quote="\u0000", escape="\u0000", emptyValue="", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_file(df: DataFrame, path: str) -> None:
    """One TSV file with a header, in the order of ``df``; parts are written by all tasks and then put together as they are."""
    spark = df.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    df.select(line.alias("value")).write.text(parts)
    store.join_files(spark, parts, path, "\t".join(df.columns) + "\n")
    store.delete(spark, parts)


def grouped_lists(refs: DataFrame, pairs: DataFrame, list_name: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, list_name) for each of refs (s1, entity_id), in the order of s1; ids by ascending q, joined by commas.

    pairs: (s1, q, q_id). A reference without pairs has an empty list.
    """
    listed = pairs.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct("q", "q_id"))).alias("l"))
    out = refs.join(listed, "s1", "left").orderBy("s1")
    return out.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(F.array_join("l.q_id", ","), F.lit("")).alias(list_name))
