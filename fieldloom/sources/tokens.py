"""Tokens of native text and of text recognition, and the choice of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_token, trim_spaces
from ..operators.aggregates import median
from ..plans.spec import HEADER, Options


def native_tokens(words: DataFrame) -> DataFrame:
    """Words (doc_id, page from 0, ord, text, x0, y0, x1, y1) of a text layer as tokens: trimmed, blanks dropped, whole
    coordinates, at least one pixel in size, without a confidence."""
    t = words.withColumn("text", trim_spaces(F.col("text"))).where("text <> ''")
    x, y = F.col("x0").cast("int"), F.col("y0").cast("int")
    return t.select(
        "doc_id", (F.col("page") + 1).cast("int").alias("page"), F.lit("native").alias("source_kind"), "ord", "text", x.alias("x"), y.alias("y"),
        F.greatest(F.lit(1), (F.col("x1") - F.col("x0")).cast("int")).alias("width"), F.greatest(F.lit(1), (F.col("y1") - F.col("y0")).cast("int")).alias("height"),
        F.lit(None).cast("double").alias("confidence"),
    )


def recognised_tokens(words: DataFrame) -> DataFrame:
    """Words (doc_id, page, ord, text, left, top, width, height, conf as text) of a recogniser as tokens: a confidence
    that is no number or negative is null."""
    conf = F.col("conf").try_cast("double")
    t = words.withColumn("text", trim_spaces(F.col("text"))).where("text <> ''")
    return t.select(
        "doc_id", "page", F.lit("ocr").alias("source_kind"), "ord", "text", F.col("left").cast("int").alias("x"), F.col("top").cast("int").alias("y"),
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.when((conf >= 0) & ~F.isnan(conf), conf).alias("confidence"),
    )


def render_scales(tokens: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows (doc_id, page, render_scale): the scale at which glyphs have the wanted height, within its bounds, and the
    first one where that would change little."""
    high = median("height", (F.length("text") >= 2) & (F.col("height") > 0))
    scale = F.greatest(F.lit(options.scales[0]), F.least(F.lit(options.scales[1]), F.lit(options.probe_scale * options.glyph_height) / F.col("high")))
    scaled = tokens.groupBy("doc_id", "page").agg(high.alias("high")).withColumn("s", F.when(F.col("high").isNull(), options.probe_scale).otherwise(scale))
    return scaled.select("doc_id", "page", F.when(F.abs(F.col("s") - options.probe_scale) > options.rescale_from, F.col("s")).otherwise(options.probe_scale).alias("render_scale"))


def chosen_pages(tokens: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows (doc_id, page, source_kind): the first page whose text layer has enough words and the header; else, of the
    first pages that were recognised, the first with the header; else the first recognised page. Where no page was
    recognised, the first with enough words in its text layer, or else the first with any."""
    page = tokens.groupBy("doc_id", "page", "source_kind").agg(F.count("*").alias("words"), F.bool_or(label_token(F.col("text")).startswith(HEADER)).alias("headed"))
    native, enough = F.col("source_kind") == "native", F.col("words") >= options.native_words
    ocr = (F.col("source_kind") == "ocr") & (F.col("page") <= options.ocr_pages)
    rank = F.when(native & enough & F.col("headed"), 0).when(ocr & F.col("headed"), 1).when(ocr, 2).when(native & enough, 3).when(native, 4)
    best = page.withColumn("rank", rank).where("rank is not null").groupBy("doc_id").agg(F.min(F.struct("rank", "page", "source_kind")).alias("b"))
    return best.select("doc_id", "b.page", "b.source_kind")
