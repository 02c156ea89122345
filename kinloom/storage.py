"""The shared folder of driver and executors, written intermediates, and small files through Spark's file systems."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without: it gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "kinloom-shared")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/kinloom-{tag}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the statement that made them ends; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Removes the files of frames made by settle(), once nothing reads them any more."""
    for df in tables:
        fs, path = _opened(df.sparkSession, df.settled_at)
        fs.delete(path, True)


def _opened(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, at: str) -> bool:
    fs, path = _opened(spark, at)
    return fs.exists(path)


def is_folder(spark: SparkSession, at: str) -> bool:
    fs, path = _opened(spark, at)
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def write_json(spark: SparkSession, value: dict, at: str) -> None:
    """A small report; a file that is there is replaced."""
    fs, path = _opened(spark, at)
    out = fs.create(path, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    out.close()


def read_json(spark: SparkSession, at: str) -> dict:
    fs, path = _opened(spark, at)
    stream = fs.open(path)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()
