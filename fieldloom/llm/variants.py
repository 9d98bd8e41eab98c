"""Spelling variants of words, grouped without pairs.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Words that differ by a replaced
one share a wildcard key, the word with a star at that position, and a word that lost one is the key of all words it can
come from. So each word stands once under each of its wildcard and deletion keys and under itself, and one pass over the
keys tells each member how many others there are and which of them is the most frequent: of the words of a wildcard key its
two most frequent ones are kept, as one of them may be the member itself. Pairs of words are never listed. Between the
words under one key only one code point differs, so a key has no more words than the alphabet has letters.

Words are the matches of a pattern in whole texts, counted with a map-side combine. Repeated rows count as often as they
stand; null and empty texts have no words; an empty table gives an empty table. Only ids, texts and result columns are used,
so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, written

#: A to Z, a to z, and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST, TIMES = 5, 3, 2


def lowered(run: Column) -> Column:
    """The run with A to Z in lower case; other capitals stay."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, upper, upper.lower()))


def thinned(every: int, id_col: str = "doc_id") -> Callable[[Column], Column]:
    """Of one lower-cased run in so many, by a hash of id and run, a code point is lost."""

    def lose(run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return lose


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUN, change: Callable[[Column], Column] | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """Rows (word, n) of all words of at least `shortest` code points that occur at least `least` times."""
    runs = df.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("run"))
    low = runs.select("doc_id", lowered(F.col("run")).alias("run"))
    words = low.select((change(F.col("run")) if change else F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def nearest(words: DataFrame) -> DataFrame:
    """Of rows (word, n): for each word the number of words near it, and the one of these with the largest n, the smallest in
    code-point order of several, as best (minus n, word); null if there is none."""
    places = F.sequence(F.lit(1), F.length("word"))

    def without(k: Column, by: str) -> Column:
        return F.concat(F.substring(F.col("word"), F.lit(1), k - 1), F.lit(by), F.substring(F.col("word"), k + 1, F.length("word")))

    keys = F.array_union(F.transform(places, lambda k: without(k, "*")), F.array_distinct(F.transform(places, lambda k: without(k, ""))))
    # Under a key, the word itself stands last.
    members = words.select(F.explode(keys).alias("key"), F.lit(False).alias("own"), "word", "n").unionByName(words.select(F.col("word").alias("key"), F.lit(True).alias("own"), "word", "n"))
    entry = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    under = Window.partitionBy("key")
    whole = under.orderBy("own", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = members.select(
        "key", "own", "word", "n",
        F.sum((~F.col("own")).cast("long")).over(whole).alias("size"),
        F.first(entry).over(whole).alias("top"),
        F.nth_value(entry, 2).over(whole).alias("second"),
        F.last(F.when(F.col("own"), entry)).over(whole).alias("itself"),
    )
    wild = F.col("key").contains("*")
    some = F.when(F.col("own"), F.col("size")).when(wild, F.col("size") - 1).otherwise(F.col("itself").isNotNull().cast("long"))
    other = F.when(F.col("own"), F.when(F.col("size") > 0, F.col("top"))).when(wild, F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top"))).otherwise(F.col("itself"))
    told = met.select("word", "n", "own", some.alias("others"), other.alias("other")).where("own or others > 0")
    return told.groupBy("word", "n").agg(F.sum("others").alias("n_near"), F.min("other").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Of rows (word, up), one for each word and up the word itself where it has no form: (word, root). Each round jumps to
    the target's target, so a chain of n forms takes log n rounds; forms at least double n, so chains are short."""
    table = written(forms, "forms")
    ends, count = table.where("word = up"), table.where("word <> up").count()
    moving = table.where("word <> up")
    while count:
        targets = moving.unionByName(ends).select(F.col("word").alias("up"), F.col("up").alias("next"))
        new = written(spread(moving, targets, "up", count).selectExpr("word", "next as up", "next <> up as moved"), "roots")
        moving = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return ends.unionByName(moving).withColumnRenamed("up", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Of rows (word, n), one for each word: form, root, n, n_near, form_n. The form of a word is the best word near it if
    that is at least `times` as frequent (times > 1); the root is where the chain of forms ends."""
    if times <= 1:
        raise ValueError("forms have to be more frequent than their words, or chains may not end")
    words = written(words.select("word", "n"), "words")
    is_form = F.coalesce(-F.col("best.minus") >= times * F.col("n"), F.lit(False))
    near = nearest(words).select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    near = written(near, "near")
    found = roots(near.select("word", F.coalesce("form", "word").alias("up")))
    return near.join(found, "word").select("word", "form", "root", "n", "n_near", "form_n")
