"""Ordered operators: islands, clusters, runs, edges, consecutive matches and firsts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored


def gap_islands(df: DataFrame, keys: list[str], value: str, order: list[str], tolerance: Column, name: str, inclusive: bool = True) -> DataFrame:
    """df with `name`: the number from 0 of the run a row is in, along `value`. A gap to the row before that exceeds the
    tolerance begins a run; with inclusive=False one that equals it does too."""
    w = W.partitionBy(*keys).orderBy(*order)
    gap = F.col(value) - F.lag(value).over(w)
    opens = (gap > tolerance) if inclusive else (gap >= tolerance)
    return df.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn(name, F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_opens")


def clusters(df: DataFrame, keys: list[str], value: str, tolerance: Column, least: int = 1) -> DataFrame:
    """One row (keys, cluster, first, last, size) per run of values no further apart than the tolerance."""
    runs = gap_islands(df.where(F.col(value).isNotNull()), keys, value, [value], tolerance, "cluster")
    return runs.groupBy(*keys, "cluster").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size")).where(F.col("size") >= least)


def walk_back(df: DataFrame, keys: list[str], order: list[Column], begin: str, end: str, limit: Column) -> DataFrame:
    """The rows of each group from the last in `order` back to the first gap: a gap is a distance from a row's end to the
    begin of the row after it above the limit."""
    w = W.partitionBy(*keys).orderBy(*order)
    broken = F.coalesce((F.lag(begin).over(w) - F.col(end) > limit).cast("int"), F.lit(0))
    return df.withColumn("_broken", broken).withColumn("_broken", F.sum("_broken").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_broken = 0").drop("_broken")


def next_edge(df: DataFrame, keys: list[str], order: list[str], value: str, margin: Column, last: Column, name: str) -> DataFrame:
    """df with `name`: the next row's value less the margin, or `last` after the last row."""
    return df.withColumn(name, F.coalesce(F.lead(value).over(W.partitionBy(*keys).orderBy(*order)) - margin, last))


def strictly_increasing(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: whether the value rises from row to row in the whole group; a null breaks it."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    falls = F.col(value).isNull() | (F.row_number().over(w) > 1) & F.coalesce(F.col(value) <= before, F.lit(True))
    return df.withColumn("_falls", falls).withColumn(name, ~F.bool_or("_falls").over(W.partitionBy(*keys))).drop("_falls")


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def consecutive(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str) -> DataFrame:
    """df with `name`: the values of a row and the n - 1 after it, null beyond the end."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.array(F.col(value), *(F.lead(value, k).over(w) for k in range(1, n))))


def neighbours(df: DataFrame, values: str, a: str, b: str) -> DataFrame:
    """The pairs (a, b) of values of an array column that follow one another, without a shuffle of its values: each value is
    read with the one at the next place."""
    at = df.select(F.col(values).alias("_values"), F.posexplode(values).alias("_at", a))
    return at.where(F.col("_at") < F.size("_values") - 1).select(a, F.get("_values", F.col("_at") + 1).alias(b))


def _ranged(df: DataFrame, keys: list[str], order: list[Column | str], carried: Column, opens: Column, name: str, ranges: int | None) -> DataFrame:
    """df with `name`: how many rows of the group, up to this one in `order`, open a run. `opens` compares a row with `_before`,
    the carried value of the row before it.

    Rows are sorted into ranges of (keys, order), so that a very large group is spread over many tasks. Each range counts
    its own openings, apart from its first row, which needs the range before; a scan over one summary row a range settles
    these and adds up what lies before. Summaries are as many as groups and ranges together."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_carried", carried).repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id())
    spread = stored(spread, "ranges")
    within = W.partitionBy(*keys, "_range").orderBy(*order)
    some = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = spread.withColumns({"_before": F.lag("_carried").over(within), "_first": F.row_number().over(within) == 1}).withColumn("_opens", some(opens & ~F.col("_first")))
    whole = within.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summary = rows.withColumns({"_last": F.last("_carried").over(whole), "_count": F.sum("_opens").over(whole)}).where("_first").drop("_before", "_carried", "_opens")
    summary = stored(summary, "summaries")
    along = W.partitionBy(*keys).orderBy("_range")
    summary = summary.withColumn("_before", F.lag("_last").over(along)).withColumn("_opens", some(opens & F.col("_before").isNotNull()))
    summary = summary.withColumn("_base", F.sum(F.col("_opens") + F.col("_count")).over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("_count"))
    base = summary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), "_base")
    counted = rows.withColumn("_own", F.sum("_opens").over(within.rowsBetween(W.unboundedPreceding, 0)))
    here = counted["_range"] == base["_r"]
    for i, k in enumerate(keys):
        here = here & counted[k].eqNullSafe(base[f"_k{i}"])
    return counted.join(base, here).select(*(counted[c] for c in df.columns), (F.col("_base") + F.col("_own")).alias(name))


def ranged_islands(df: DataFrame, keys: list[str], value: str, order: list[str], tolerance: Column, name: str, inclusive: bool = True, ranges: int | None = None) -> DataFrame:
    """gap_islands for groups that are too large for one task; the order has to begin with the value."""
    gap = F.col(value) - F.col("_before")
    return _ranged(df, keys, order, F.col(value), (gap > tolerance) if inclusive else (gap >= tolerance), name, ranges)


def ranged_walk_back(df: DataFrame, keys: list[str], order: list[Column], begin: str, end: str, limit: Column, ranges: int | None = None) -> DataFrame:
    """walk_back for groups that are too large for one task."""
    return _ranged(df, keys, order, F.col(begin), F.col("_before") - F.col(end) > limit, "_broken", ranges).where("_broken = 0").drop("_broken")


def ranged_totals(df: DataFrame, keys: list[str], order: list[Column | str], names: list[str], ranges: int | None = None) -> DataFrame:
    """df with the named columns as running totals of each group in `order`, this row included, for groups that are too large
    for one task: each range of rows is summed up to each row, and what the ranges before it hold is added."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stored(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = spread.withColumns({c: F.sum(c).over(within) for c in names})
    along = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = spread.groupBy(*keys, "_range").agg(*(F.sum(c).alias(c) for c in names))
    base = whole.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"_b{i}") for i, c in enumerate(names)))
    here = rows["_range"] == base["_r"]
    for i, k in enumerate(keys):
        here = here & rows[k].eqNullSafe(base[f"_k{i}"])
    at = {c: f"_b{i}" for i, c in enumerate(names)}
    return rows.join(base, here).select(*((rows[c] + F.col(at[c])).alias(c) if c in at else rows[c] for c in df.columns))
