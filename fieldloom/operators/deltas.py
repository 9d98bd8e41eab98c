"""Write-back to a table that is not rewritten: rows lie in buckets by key, updates are appended to a table of the same
buckets and merged when they are read.

Table and updates have one number of buckets, so neither reading nor compacting shuffles the table; only new updates are
dealt to their buckets. Rows of a key that stands on many updates lie in one bucket: compact before these outgrow a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder

VERSION = "_version"


def _write(df: DataFrame, name: str, key: str, buckets: int) -> None:
    # Dealt by the rule of the buckets first, so that each bucket is one file of one task.
    dealt = df.repartition(buckets, key)
    dealt.write.mode("append").bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(df.sparkSession)}/{name}").saveAsTable(name)


def create(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table in buckets by key, and its empty table of updates. It stands in the session's catalog, its files in the shared folder."""
    _write(df, name, key, buckets)
    _write(df.limit(0).withColumn(VERSION, F.lit(0).cast("long")), f"{name}_updates", key, buckets)


def write_back(spark: SparkSession, name: str, updates: DataFrame, key: str, version: int, buckets: int) -> None:
    """Append new values of some columns, all columns of updates but the key; the others keep theirs. An update counts from its
    version on, a write that is repeated under one version changes nothing, and of several rows of a key in one version the
    largest counts."""
    table = spark.table(name)
    changed = [c for c in updates.columns if c != key]
    if VERSION in table.columns or set(updates.columns) - set(table.columns):
        raise ValueError(f"updates may have the table's columns only, and none may be called {VERSION}")
    if set(changed) != set(table.columns) - {key}:
        # A version is a whole row, so what is not changed is taken from the table as it reads now.
        updates = merged(spark, name, key).drop(*changed).join(updates, key)
    _write(updates.select(*(F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns), F.lit(version).cast("long").alias(VERSION)), f"{name}_updates", key, buckets)


def merged(spark: SparkSession, name: str, key: str) -> DataFrame:
    """The table with the latest update of each key, null values included. Keys that only updates have, and null keys, change nothing."""
    table, updates = spark.table(name), spark.table(f"{name}_updates")
    others = [c for c in table.columns if c != key]
    latest = updates.groupBy(key).agg(F.max(F.struct(VERSION, *others)).alias("_new"))
    both = table.join(latest, key, "left")
    return both.select(*(F.col(c) if c == key else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in table.columns))


def compact(spark: SparkSession, name: str, key: str, into: str, buckets: int) -> None:
    """Write the merged rows as a new table without updates. The old one stays as it is until its reader drops it."""
    create(merged(spark, name, key), into, key, buckets)
