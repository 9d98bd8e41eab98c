"""A similarity join of two tables of short texts by an index, without comparing every pair.

The Ratcliff-Obershelp ratio of two texts of n and m characters is 2 M / (n + m), and the M characters that match are a
common subsequence. A ratio of `least` therefore needs a common subsequence of L = ceil(least (n + m) / 2) characters, and
for each pair of lengths that leaves one of two exact ways to meet:

deletions  both texts have the subsequence, so each stands under all texts that n - L or m - L deletions leave of it;
segments   where those are more than MOST, the left text is cut into n + m - 2 L + 1 segments, of which an alignment leaves
           one whole, and the right text stands under every substring that can be it.

So every pair that can reach the ratio meets under some key, which holds the lengths besides. Only these candidates are
compared: first by edit distance in the JVM, then by the ratio itself. Frequent segments are dealt over tasks from both
sides (dealt_pairs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import may_reach, ratio
from .joins import dealt_pairs

#: Keys of one text by deletions for one length of its partner, at most.
MOST = 64


def _without(text: Column, depth: Column) -> Column:
    """All texts that remain after so many deletions."""
    places = lambda s: F.sequence(F.lit(1), F.length(s))
    fewer = lambda s: F.transform(places(s), lambda k: F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.length(s))))
    again = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.reduce(again, F.array(text), lambda found, _: F.array_distinct(F.flatten(F.transform(found, fewer))))


def _choices(n: Column, k: Column) -> Column:
    """How many ways there are to delete k of n characters."""
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.reduce(steps, F.lit(1.0), lambda out, j: out * (n - j + 1) / j)


def _keyed(texts: DataFrame, name: str, least: float, is_left: bool) -> DataFrame:
    """Rows (name, key) of the distinct texts of a column."""
    own, other = F.col("_own"), F.col("_other")
    rows = texts.select(name).where(F.length(name) > 0).distinct().withColumn("_own", F.length(name))
    reach = (2 - least) / least
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(own / reach - 1e-9).cast("int")), F.floor(own * reach + 1e-9).cast("int"))
    rows = rows.withColumn("_other", F.explode(lengths)).withColumn("_common", F.ceil((own + other) * (least / 2) - 1e-9).cast("int"))
    rows = rows.where(F.col("_common") <= F.least(own, other)).withColumns({"_lost": own - F.col("_common"), "_gone": other - F.col("_common")})
    few = (_choices(own, F.col("_lost")) <= MOST) & (_choices(other, F.col("_gone")) <= MOST)
    n, m = (own, other) if is_left else (other, own)
    ahead, behind = ("_lost", "_gone") if is_left else ("_gone", "_lost")  # deletions from the left text, from the right one
    pieces = F.col("_lost") + F.col("_gone") + 1
    start = lambda s: F.floor(s * n / pieces).cast("int")
    size = lambda s: start(s + 1) - start(s)
    every = F.sequence(F.lit(0), pieces - 1)
    piece = lambda s, at: F.concat_ws(" ", s, F.substring(F.col(name), at + 1, size(s)))
    if is_left:
        segments = F.transform(every, lambda s: piece(s, start(s)))
    else:
        shifts = F.sequence(-F.col(ahead), F.col(behind))
        segments = F.flatten(F.transform(every, lambda s: F.transform(F.filter(shifts, lambda d: (start(s) + d >= 0) & (start(s) + d + size(s) <= own)), lambda d: piece(s, start(s) + d))))
    keys = F.when(few, F.transform(_without(F.col(name), F.col("_lost")), lambda k: F.concat_ws(" ", F.lit("-"), k))).otherwise(F.array_distinct(segments))
    return rows.select(name, F.explode(keys).alias("_key"), n.alias("_n"), m.alias("_m")).select(name, F.concat_ws(" ", "_n", "_m", "_key").alias("key"))


def candidates(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.85) -> DataFrame:
    """Distinct pairs (a, b) of texts with a common subsequence that may be long enough; every such pair is there."""
    met = dealt_pairs(_keyed(left, a, least, True), _keyed(right, b, least, False), "key")
    return met.where(may_reach(F.col(a), F.col(b), least)).select(a, b).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.85) -> DataFrame:
    """Rows (a, b, forth, back): all pairs of distinct non-empty texts of a column of left and one of right whose ratio is
    `least` or more in either order; the ratio depends on the order of its arguments. The names have to differ. Rows are
    joined back by their texts, so repeated texts cost nothing here; nulls and empty texts are in no pair."""
    found = candidates(left, right, a, b, least)
    return found.withColumns({"forth": ratio(a, b), "back": ratio(b, a)}).where(F.greatest("forth", "back") >= least)
