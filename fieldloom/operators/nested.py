"""Ordered operators within a row: what windows and joins do for the rows of a small group, for the items of an array. A group
that is one row is neither shuffled nor sorted again from step to step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for each row. withColumns lets the optimizer put an expression wherever its name
    stands, and in a function of items that is once for each item."""
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(*(F.col(c) for c in df.columns if c not in columns), F.inline(F.array(made)))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """computed within an expression: the body of a value that is computed once. It is the last step of an aggregate of
    nothing, which, unlike transform, does not copy what it gives."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def islands(items: Column, value: str | None, tolerance: Column, body: Callable[[Column, Column], Column]) -> Column:
    """The body of each island, an array, and its number: items, in the order of a member or of their own values, with no
    larger gap than the tolerance between neighbours. windows.gap_islands within a row."""

    def cut(s: Column, v: Column) -> Column:
        places = F.slice(F.sequence(F.lit(0), F.size(s)), F.lit(1), F.size(s))
        opens = F.filter(places, lambda i: (i == 0) | (F.get(v, i) - F.get(v, i - 1) > tolerance))
        return once(opens, lambda at: F.transform(at, lambda k, i: once(F.slice(s, k + 1, F.coalesce(F.get(at, i + 1), F.size(s)) - k), lambda part: body(part, i))))

    return once(items, lambda s: once(s if value is None else s[value], lambda v: cut(s, v)))


def last_run(items: Column, begin: Callable[[Column], Column], end: Callable[[Column], Column], limit: Column) -> Column:
    """The first item of the last run of items in order, null where there is none: a distance from an item's end to the next
    one's begin above the limit begins a run. windows.walk_back within a row."""
    opens = lambda s: F.filter(s, lambda x, i: (i == 0) | (begin(x) - end(F.get(s, i - 1)) > limit))
    return once(items, lambda s: F.try_element_at(opens(s), F.lit(-1)))


def middle(values: Column) -> Column:
    """The exact median of an array, null where it is empty."""
    k = lambda s, up: F.get(s, F.floor((F.size(s) - 1 + up) / 2).cast("int")).cast("double")
    return once(F.sort_array(values), lambda s: (k(s, 0) + k(s, 1)) / 2)


def average(values: Column) -> Column:
    """The mean of the values that are not null, null where there is none."""
    return once(F.array_compact(values), lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(s), F.lit(0)))


def joined(texts: Column) -> Column:
    return F.array_join(texts, " ")
