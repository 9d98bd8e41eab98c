"""The Ratcliff-Obershelp ratio, which no built-in gives, behind a cheap necessary condition that one does."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import normalize_plate, plate_confusables


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over all characters; the order of the arguments matters."""
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(ArrayType(DoubleType()))
def ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ratio of the texts of two arrays, place by place."""
    for left, right in pairs:
        yield pd.Series([[SequenceMatcher(None, a, b).ratio() for a, b in zip(x, y)] for x, y in zip(left, right)])


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only where the ratio is below `least`: the matches are a common subsequence at most."""
    return F.levenshtein(a, b) <= (1 - least) * (F.length(a) + F.length(b)) + 1e-9


def plates_match(found: Column, requested: Column, least: float = 0.85) -> Column:
    """Whether two plates are one but for glyphs read for one another, or for a little noise."""
    a, b = plate_confusables(found), plate_confusables(requested)
    # Pairs that cannot reach it go to Python as nulls: a condition around a Python function would not spare it a row.
    reach = may_reach(a, b, least) & (a != b)
    near = F.coalesce(ratio(F.when(reach, a), F.when(reach, b)) >= least, F.lit(False))
    return F.when((normalize_plate(found) == "") | (normalize_plate(requested) == ""), False).otherwise((a == b) | near)
