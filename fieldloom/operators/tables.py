"""Intermediate tables in the shared folder: they cut the lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of stored tables: what each writing task holds in memory.
ROW_GROUP = 16 << 20


#: The folder in use: one of our own where a local session has none set, or that of temporary_tables.
_IN_USE: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets one of its own; on a
    cluster that is an error, because executors and driver share no local folder."""
    if not (folder := _IN_USE.get() or spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _IN_USE.set(folder := tempfile.mkdtemp(prefix="spark-"))
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged_in(df: DataFrame) -> DataFrame:
    """df as a side of joins that is sorted and never broadcast. Without this Spark judges a table by its files, and these are
    a small share of their rows where rows are alike, or where a row is exploded into many, so that a table as long as the
    input would go through the driver."""
    return df.hint("merge")


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """Tables stored inside go to a folder of their own, which is removed at the end: write results before it."""
    folder = f"{shared_folder(spark)}/temporary-{uuid.uuid4().hex}"
    token = _IN_USE.set(folder)
    try:
        yield folder
    finally:
        _IN_USE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
