"""Which tokens are the label of which field: whole patterns first, then keywords, then keywords by similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import may_reach, ratios
from ..functions.text import ORDINALS
from ..operators.nested import computed, joined, once
from ..operators.tables import stored
from .spec import FIELDS, ORDINAL, PLATE, Field, Options

#: The fields whose labels are looked for, in the order of `labels`.
SOUGHT = (*FIELDS, PLATE)


def fits(norm: Column, word: str) -> Column:
    return norm.isin(*ORDINALS) if word == ORDINAL else norm.startswith(word)


def some(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def whole(token: Column, pattern: tuple[str, ...]) -> Column:
    """Whether a token and those after it, its norms, fit a whole pattern; the last word, which fewest fit, is tried first."""
    return reduce(lambda a, b: a & b, (F.coalesce(fits(F.get(token["norms"], F.lit(k)), word), F.lit(False)) for k, word in reversed(list(enumerate(pattern)))))


def keyword(norm: Column, field: Field, options: Options) -> Column:
    """Whether a token alone is a keyword of the field; the plate has none."""
    if field is PLATE:
        return F.lit(False)
    return some([norm.startswith(w) | (norm.endswith(w) if len(w) >= options.fuzzy_length else F.lit(False)) for w in sorted({p[-1] for p in field.patterns})])


def match(tier: int, token: Column, pattern: int, worse: Column, span: int) -> Column:
    """A candidate; the least one of a field is its label. Better tiers come first, then columns, rows, patterns and places."""
    place = (token[c].alias(c) for c in ("start", "at"))
    return F.struct(F.lit(tier).alias("tier"), token["column_index"].alias("column_index"), token["band"].alias("band"), F.lit(pattern).alias("pattern"), worse.alias("worse"), *place, F.lit(span).alias("span"))


def tokens_of(lines: Column, kept: Callable[[Column], Column]) -> Column:
    """The label tokens of lines whose norm is wanted, each with its place and the norms from it on."""
    most = max(len(p) for f in SOUGHT for p in f.patterns)

    def of_line(line: Column, at: Column) -> Column:
        norms = line["norms"]
        each = lambda n, k: F.when(kept(n), F.struct(line["column_index"].alias("column_index"), line["band"].alias("band"), (k + 1).alias("start"), at.alias("at"), F.slice(norms, k + 1, most).alias("norms")))
        return F.array_compact(F.transform(norms, each))

    return F.flatten(F.transform(lines, of_line))


def sure(tokens: Column, field: Field, options: Options) -> Column:
    """The best match of a field by a whole pattern or a keyword, null where there is none."""

    def best(t: Column) -> Column:
        # Of one token's matches the first that holds is the least one.
        own = F.when(keyword(F.get(t["norms"], F.lit(0)), field, options), match(2, t, 0, F.lit(0.0), 1))
        for k in range(len(field.patterns) - 1, -1, -1):
            own = F.when(whole(t, field.patterns[k]), match(1, t, k, F.lit(0.0), len(field.patterns[k]))).otherwise(own)
        return own

    return F.array_min(F.transform(tokens, best))


def near_misses(lines: Column, matches: Column, options: Options) -> Column:
    """Tokens whose end may be a keyword, misread, of a field that nothing else found."""
    words = [(k, w) for k, f in enumerate(FIELDS) for w in sorted({p[-1] for p in f.patterns}) if len(w) >= options.fuzzy_length]
    least = min(len(w) for _, w in words)
    open_words = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("word")) for k, w in words)), lambda w: F.get(matches, w["k"]).isNull())
    tokens = tokens_of(lines, lambda norm: F.length(norm) >= least)

    def pairs(t: Column) -> Column:
        norm = F.get(t["norms"], F.lit(0))
        each = lambda w: F.struct(w["k"].alias("k"), w["word"].alias("word"), F.right(norm, F.length(w["word"])).alias("tail"), t.alias("token"))
        long = F.filter(open_words, lambda w: F.length(norm) >= F.length(w["word"]))
        return F.filter(F.transform(long, each), lambda p: may_reach(p["tail"], p["word"], options.fuzzy_ratio))

    return F.when(F.size(open_words) > 0, F.flatten(F.transform(tokens, pairs)))


def located(cells: DataFrame, options: Options = Options()) -> DataFrame:
    """cells with `labels`, an array with an item for each sought field, null where no label is found: (tier, at, matched,
    label_top, label_bottom), `at` being the line's place. In the last tier the most similar token of a row counts.
    Similarity runs only for fields that nothing else found, and only their documents go to Python."""
    lines = F.col("lines")
    likely = lambda n: some([fits(n, p[0]) for f in SOUGHT for p in f.patterns] + [keyword(n, f, options) for f in FIELDS])
    d = computed(cells, {"_tokens": tokens_of(lines, likely)})
    d = computed(d, {"matches": F.array(*(sure(F.col("_tokens"), f, options) for f in SOUGHT))}).drop("_tokens")
    d = stored(computed(d, {"misses": near_misses(lines, F.col("matches"), options)}), "labels")
    open_ = F.coalesce(F.size("misses") > 0, F.lit(False))
    likeness = d.where(open_).withColumn("likeness", ratios(F.col("misses.tail"), F.col("misses.word")))
    similar = F.filter(F.transform("misses", lambda m, i: F.struct(m["k"].alias("k"), match(3, m["token"], 0, -F.get("likeness", i), 1).alias("match"))), lambda m: m["match"]["worse"] <= -options.fuzzy_ratio)
    best = lambda k: F.array_min(F.transform(F.filter(F.col("similar"), lambda m: m["k"] == k), lambda m: m["match"]))
    read = computed(computed(likeness, {"similar": similar}), {"matches": F.transform("matches", lambda m, k: F.coalesce(m, best(k)))})
    every = d.where(~open_).drop("misses").unionByName(read.select(*(c for c in d.columns if c != "misses")))

    def label(m: Column) -> Column:
        run = lambda line, name: F.slice(line[name], m["start"], m["span"])
        return once(F.get(lines, m["at"]), lambda x: F.struct(m["tier"].alias("tier"), m["at"].alias("at"), joined(run(x, "texts")).alias("matched"), F.array_min(run(x, "tops")).alias("label_top"), F.array_max(run(x, "bottoms")).alias("label_bottom")))

    return computed(every, {"labels": F.transform("matches", lambda m: F.when(m.isNotNull(), label(m)))}).drop("matches")
