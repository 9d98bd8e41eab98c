"""Aggregations: exact medians, ordered text, hulls, pivots and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored


def median(value: Column | str, only: Column | None = None, default: float | None = None) -> Column:
    """The exact median, the mean of the middle two where the count is even."""
    v = F.col(value) if isinstance(value, str) else value
    m = F.median(v if only is None else F.when(only, v))
    return m if default is None else F.coalesce(m, F.lit(default))


#: Steps of each histogram, accuracy of its sketch, and values of a group that may meet in one task.
STEPS, ACCURACY, FEW = 1000, 10_000, 10_000


def _beside(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right where the named ones are equal, nulls too."""
    right = right.withColumnsRenamed({c: f"{c}_r" for c in names})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in names), F.lit(True))
    return left.join(right, same, how).drop(*(f"{c}_r" for c in names))


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str, steps: int = STEPS, few: int = FEW) -> DataFrame:
    """Rows (keys, name): the exact median of each group, however large, by histograms that are refined.

    A round makes a histogram of equal depth from a sketch of each group, which names two values around the middle rank. What
    lies below, at, between and above them is then counted exactly, and the next round goes on with the part that holds the
    middle: whatever the distribution, about 3 / steps of the values. Where at most `few` are left, they are sorted. Sketches
    and counts combine before the shuffle. A round reads df twice, so that should be a stored table. Nulls and NaN do not
    count; a group of nothing else has a null median. What is joined with the rows is a row or two for each group; Spark
    broadcasts it while it is small."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(c).alias(k) for k, c in zip(ks, keys)), v.alias("_v"))
    groups = stored(rows.groupBy(*ks).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "groups")
    middle = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    todo = groups.where("_n > 0").select(*ks, F.explode(middle).alias("_rank"), "_lo", "_hi", "_n").withColumn("_at", F.col("_rank"))
    part, found, small = [*ks, "_lo", "_hi"], [], []

    def between(bounds: DataFrame, *more: str) -> DataFrame:
        return _beside(rows, bounds.select(*part, *more).distinct(), ks).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    while True:
        todo = stored(todo, "bounds")
        found.append(todo.where("_lo = _hi").select(*ks, "_rank", F.col("_lo").alias("_v")))
        small.append(todo.where(f"_lo < _hi and _n <= {few}"))
        todo = todo.where(f"_lo < _hi and _n > {few}")
        if todo.isEmpty():
            break
        depth = between(todo).groupBy(*part).agg(F.percentile_approx("_v", [k / steps for k in range(steps + 1)], ACCURACY).alias("_q"))
        at = F.col("_at") / F.col("_n") * steps
        step = lambda k: F.get("_q", F.least(F.greatest(k, F.lit(0)), F.lit(steps)).cast("int"))
        todo = _beside(todo, depth, part).select(*todo.columns, step(F.floor(at) - 1).alias("_a"), step(F.ceil(at) + 1).alias("_b"))
        todo = stored(todo, "brackets")
        x, a, b = F.col("_v"), F.col("_a"), F.col("_b")
        inside = (x > a) & (x < b)
        counts = between(todo, "_a", "_b").groupBy(*part, "_a", "_b").agg(
            F.count_if(x < a).alias("_n0"), F.count_if(x == a).alias("_n1"), F.count_if(inside).alias("_n2"), F.count_if((x == b) & (a < b)).alias("_n3"),
            F.max(F.when(x < a, x)).alias("_before"), F.min(F.when(inside, x)).alias("_first"), F.max(F.when(inside, x)).alias("_last"), F.min(F.when(x > b, x)).alias("_after"),
        )
        rank, n, n0, n1, n2, n3 = (F.col(c) for c in ("_at", "_n", "_n0", "_n1", "_n2", "_n3"))
        cases = (
            (n0, F.col("_lo"), F.col("_before"), n0, rank), (n0 + n1, a, a, n1, F.lit(0)), (n0 + n1 + n2, F.col("_first"), F.col("_last"), n2, rank - n0 - n1),
            (n0 + n1 + n2 + n3, b, b, n3, F.lit(0)), (n, F.col("_after"), F.col("_hi"), n - n0 - n1 - n2 - n3, rank - n0 - n1 - n2 - n3),
        )
        pick = lambda k: reduce(lambda out, case: out.when(rank < case[0], case[k].cast("double" if k < 3 else "long")), cases, F)
        todo = _beside(todo, counts, [*part, "_a", "_b"]).select(*ks, "_rank", *(pick(k).alias(c) for k, c in ((1, "_lo"), (2, "_hi"), (3, "_n"), (4, "_at"))))
    rest = reduce(DataFrame.unionByName, small)
    lists = between(rest).groupBy(*part).agg(F.array_sort(F.collect_list("_v")).alias("_all"))
    found.append(_beside(rest, lists, part).select(*ks, "_rank", F.get("_all", F.col("_at").cast("int")).alias("_v")))
    low, high = F.min("_v"), F.max("_v")
    mean = F.when(low == high, low).when(F.abs(low / 2 + high / 2) < 1e300, (low + high) / 2).otherwise(low / 2 + high / 2)
    medians = reduce(DataFrame.unionByName, found).groupBy(*ks).agg(mean.alias(name))
    return _beside(groups, medians, ks, "left").select(*(F.col(k).alias(c) for k, c in zip(ks, keys)), name)


def ordered_text(text: Column | str, order: list[Column | str], separator: str = " ") -> Column:
    """The texts of a group joined in order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in [*order, text]]
    each = F.struct(*(c.alias(f"c{k}") for k, c in enumerate(cols)))
    return F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x[f"c{len(order)}"]), separator)


def pivoted(df: DataFrame, keys: list[str], name: str, value: str, names: list[str], how=F.first) -> DataFrame:
    """One column for each of the given names, null (or the aggregate of nothing) where a group lacks it."""
    return df.groupBy(*keys).pivot(name, names).agg(how(value))


def shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys, and their share of all rows."""
    total = df.agg(F.count("*").alias("_total"))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("_total")).alias("share"))


def all_hold(df: DataFrame, keys: list[str], name: str, ok: Column) -> DataFrame:
    """Rows (keys, all_ok, failed): whether a check holds on every row of a group, and the names of those where it does
    not, in order. A check that gives null does not hold."""
    holds = F.coalesce(ok, F.lit(False))
    return df.groupBy(*keys).agg(F.bool_and(holds).alias("all_ok"), F.array_join(F.array_sort(F.collect_set(F.when(~holds, F.col(name)))), ", ").alias("failed"))
