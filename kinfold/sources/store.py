"""Files of a run through Hadoop's file systems, so that a folder may be of any store that Spark reads."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path):
    made = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def at(spark: SparkSession, root, *more: str) -> str:
    """The full address of a path, by the default file system where it names none."""
    path, fs = _path(spark, "/".join([str(root).rstrip("/") or "/", *more]))
    return fs.makeQualified(path).toString()


def exists(spark: SparkSession, path) -> bool:
    made, fs = _path(spark, path)
    return fs.exists(made)


def is_dir(spark: SparkSession, path) -> bool:
    made, fs = _path(spark, path)
    return fs.exists(made) and fs.getFileStatus(made).isDirectory()


def done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def walk(spark: SparkSession, root) -> Iterator[tuple[str, list[str], list[str]]]:
    """(folder, folders in it, files in it) from the root down, sorted; links are followed."""
    made, fs = _path(spark, root)
    if not fs.exists(made):
        return
    found = fs.listStatus(made)
    names = {True: [], False: []}
    for status in found:
        names[bool(status.isDirectory())].append(status.getPath().getName())
    yield str(root), sorted(names[True]), sorted(names[False])
    for name in sorted(names[True]):
        yield from walk(spark, f"{root}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    made, fs = _path(spark, path)
    fs.delete(made, True)


def copy(spark: SparkSession, source, target) -> None:
    """A file or folder to ``target``, in place of what is there."""
    one, one_fs = _path(spark, source)
    two, two_fs = _path(spark, target)
    two_fs.mkdirs(two.getParent())
    if two_fs.exists(two):
        two_fs.delete(two, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(one_fs, one, two_fs, two, False, spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path) -> str:
    made, fs = _path(spark, path)
    stream = fs.open(made)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, text: str, path) -> None:
    made, fs = _path(spark, path)
    stream = fs.create(made, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def save_json(spark: SparkSession, value, path) -> None:
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=2), path)


def load_json(spark: SparkSession, path):
    return json.loads(read_text(spark, path))


def join_files(spark: SparkSession, folder: str, target: str, head: str) -> None:
    """The part files of a folder, in the order of their names, as one file after ``head``; bytes are streamed."""
    made, fs = _path(spark, target)
    out = fs.create(made, True)
    conf = spark._jsc.hadoopConfiguration()
    try:
        out.write(bytearray(head.encode("utf-8")))
        for part in next(walk(spark, folder))[2]:
            if part.startswith("part-"):
                path, source = _path(spark, f"{folder}/{part}")
                stream = source.open(path)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                finally:
                    stream.close()
    finally:
        out.close()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


#: For each open settled(), the tables that were written since.
_passing: list[list[str]] = []


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, arrow_rows: int | None = None, arrow_least: int = 0) -> DataFrame:
    """``df`` from a table in the shared folder, which goes when the driver's JVM ends. arrow_rows: most rows of an Arrow batch, for wide ones;
    arrow_least: a limit that isn't less than this, for narrow ones whose values recur."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_ARROW_ROWS)
    if arrow_rows or arrow_least:
        spark.conf.set(_ARROW_ROWS, str(max(min(int(before), arrow_rows or int(before)), arrow_least)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    made, fs = _path(spark, path)
    fs.deleteOnExit(made.getParent())
    for tables in _passing:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str, arrow_least: int = 0) -> DataFrame:
    """What ``make`` returns, written; the tables that were written on the way go at once."""
    _passing.append([])
    try:
        df = make()
    finally:
        tables = _passing.pop()
    out = written(df, name, arrow_least=arrow_least)
    for path in tables:
        delete(out.sparkSession, path)
    return out
