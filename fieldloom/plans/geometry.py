"""Where a page's section is and how its columns lie. Tokens are (doc_id, ord, text, x, y, width, height, confidence) of
one page for each document, with that page's size. They are gathered once, into one row for each page; every later step
works on the arrays of that row, so one shuffle serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_token
from ..operators.nested import average, computed, islands, joined, last_run, middle, once
from ..operators.tables import merged_in
from .spec import FALLBACK_COLUMNS, FOOTERS, HEADER, Options, pixels


def placed(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """One row (doc_id, page_width, page_height, tokens) for each page: its tokens by height, with their derived edges and
    normal form. A page without tokens has an empty array."""
    text, norm = F.col("text"), F.col("norm")
    t = tokens.withColumn("norm", label_token(text)).select(
        "doc_id", "x", (F.col("y") + F.col("height") / 2).alias("center_y"), "ord", (F.col("x") + F.col("width")).alias("right"), (F.col("x") + F.col("width") / 2).alias("center_x"),
        "y", (F.col("y") + F.col("height")).alias("bottom"), "text", "norm", "confidence", text.startswith(":").alias("colon"), norm.startswith(HEADER).alias("heads"), norm.isin(*FOOTERS).alias("foots"),
        F.when((F.length(text) >= 3) & (F.col("width") > 0), F.col("width") / F.length(text)).alias("glyph"),
    )
    gathered = t.groupBy("doc_id").agg(F.collect_list(F.struct("center_y", "ord", F.struct(*t.columns[1:]).alias("t"))).alias("tokens"))
    sizes = pages.groupBy("doc_id").agg(F.max("width").alias("page_width"), F.max("height").alias("page_height"))
    # Arrays are sorted by the first members of their items: these by height, and those of `across` by x.
    by_height = F.sort_array(F.coalesce("tokens", F.array().cast(gathered.schema["tokens"].dataType)))
    return sizes.join(merged_in(gathered), "doc_id", "left").withColumn("tokens", by_height["t"])


def across(tokens: Column) -> Column:
    """Tokens from left to right."""
    return F.sort_array(tokens)


def section_tokens(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """pages with header_found, section_top, section_bottom, and `inside`: the tokens of the section, or all tokens where it
    holds none. Pages without tokens have no section."""
    tokens, height = F.col("tokens"), F.col("page_height")
    head = F.array_min(F.transform(F.filter(tokens, lambda t: t["heads"]), lambda t: F.struct(t["y"].alias("y"), t["ord"], t["bottom"].alias("bottom"))))
    foot = lambda head: F.array_min(F.filter(tokens, lambda t: t["foots"] & (t["y"] > head["bottom"]))["y"])

    def edges(head: Column, foot: Column) -> Column:
        floor = F.least(height, head["y"] + pixels(options.fallback_height, "page_height"))
        low = F.when(foot > head["y"], foot).otherwise(floor)
        return F.struct(head.isNotNull().alias("found"), F.coalesce(head["y"], F.lit(0)).alias("top"), F.when(head.isNotNull(), low).otherwise(height).alias("bottom"))

    d = computed(pages, {"_edge": once(head, lambda h: once(foot(h), lambda f: edges(h, f)))})
    d = computed(d, {"_inside": F.filter(tokens, lambda t: t["center_y"].between(F.col("_edge.top"), F.col("_edge.bottom")))})
    some = F.size("_inside") > 0
    edge = lambda name, whole: F.when(some, F.col(f"_edge.{name}")).when(F.size(tokens) > 0, whole)
    found = {"header_found": F.when(F.size(tokens) > 0, F.col("_edge.found")), "section_top": edge("top", F.lit(0)), "section_bottom": edge("bottom", height), "inside": F.when(some, F.col("_inside")).otherwise(tokens)}
    return computed(d, found).drop("_edge", "_inside")


def section_text(inside: Column) -> Column:
    """The section's text in reading order, null where it has no token."""
    each = F.transform(inside, lambda t: F.struct(t["center_y"], t["x"], t["ord"], t["text"].alias("text")))
    return F.when(F.size(inside) > 0, joined(F.sort_array(each)["text"]))


def ruled(sections: DataFrame, options: Options = Options()) -> DataFrame:
    """sections with `columns`, an array of (column_index, label_left, colon_x, value_left, column_right, fallback). A document
    whose colons do not show at least two columns in rising order has the three usual ones."""
    inside, tol = F.col("inside"), pixels(options.anchor, "page_width")
    colons = F.filter(inside, lambda t: t["colon"] & (F.length(F.trim(t["text"])) <= 2))
    glyph = F.coalesce(middle(F.array_compact(inside["glyph"])), F.lit(6.0))
    # Rows of tokens from left to right; only those with a colon can hold a label.
    some = lambda r, _: F.when(F.exists(r, lambda t: t["colon"]), across(r))
    rows = F.array_compact(islands(inside, "center_y", F.lit(options.row_band) * F.col("page_height"), some))
    near = F.lit(options.colon_cluster) * F.col("page_width")
    anchors = F.array_compact(islands(F.sort_array(colons["x"]), None, near, lambda c, _: F.when(F.size(c) >= 3, F.get(c, F.lit(0)))))
    d = computed(sections, {"_rows": rows, "_anchors": anchors, "_limit": F.lit(options.run_gap_glyphs) * glyph, "_tol": tol})

    def label_left(x: Column) -> Column:
        # In each row with a colon on the anchor, where the run of tokens that ends at it begins.
        marked = F.filter(F.col("_rows"), lambda r: F.exists(r, lambda i: i["colon"] & (F.abs(i["x"] - x) <= F.col("_tol"))))
        starts = F.transform(marked, lambda r: last_run(F.filter(r, lambda i: i["right"] <= x + 2), lambda i: i["x"], lambda i: i["right"], F.col("_limit"))["x"])
        return middle(F.array_compact(starts)).cast("int")

    d = computed(d, {"_lefts": F.transform(F.col("_anchors"), label_left)})
    lefts = F.col("_lefts")
    rising = F.forall(F.transform(lefts, lambda x, i: x.isNotNull() & ((i == 0) | F.coalesce(x > F.get(lefts, i - 1), F.lit(False)))), lambda ok: ok)
    margin = pixels(options.right_margin, "page_width")
    beyond = lambda x: F.coalesce(F.array_min(F.filter(F.col("inside.x"), lambda other: other > x)), x)
    own = F.transform(F.col("_anchors"), lambda x, i: F.struct(
        i.alias("column_index"), F.get(lefts, i).alias("label_left"), x.alias("colon_x"), beyond(x + F.col("_tol")).alias("value_left"),
        F.coalesce(F.get(lefts, i + 1) - margin, F.col("page_width").cast("int")).alias("column_right"), F.lit(False).alias("fallback"),
    ))
    usual = F.array(*(
        F.struct(F.lit(k).alias("column_index"), pixels(a, "page_width").alias("label_left"), pixels(b, "page_width").alias("colon_x"), pixels(c, "page_width").alias("value_left"),
                 (pixels(FALLBACK_COLUMNS[k + 1][0], "page_width") - margin if k < 2 else F.col("page_width").cast("int")).alias("column_right"), F.lit(True).alias("fallback"))
        for k, (a, b, c) in enumerate(FALLBACK_COLUMNS)
    ))
    columns = F.when((F.size("_anchors") >= 2) & rising, own).when(F.size(inside) > 0, usual)
    return computed(d, {"columns": columns}).drop("_rows", "_limit", "_tol", "_anchors", "_lefts")


def columns(sections: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows (doc_id, column_index, label_left, colon_x, value_left, column_right, fallback)."""
    return ruled(sections, options).select("doc_id", F.inline("columns"))


def cells(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """pages with `lines`: section tokens by the columns they reach into, banded into rows there. A line is (column_index, band,
    texts, norms, tops, bottoms, raw, token_conf, first_x): arrays of the tokens up to the colon from left to right, and the
    text of those from the colon on, their mean confidence and the leftmost place. Lines without the former are left out. `columns`
    gets `values`: the tokens (x, ord, center_y, text, confidence) of the page that are centred in a column's values."""
    edges = lambda c: F.struct(
        (c["label_left"] - pixels(options.column_inset, "page_width")).alias("low"), c["column_right"].alias("high"), (c["colon_x"] + pixels(options.anchor, "page_width")).alias("until"),
        (c["colon_x"] - pixels(options.anchor, "page_width")).alias("since"), (c["colon_x"] + pixels(options.cell_inset, "page_width")).alias("left"), F.least("page_width", c["column_right"]).alias("right"),
    )

    def line(column: Column, band: Column, edge: Column, tokens: Column) -> Column:
        labels = F.filter(tokens, lambda t: (t["right"] <= edge["until"]) & (t["norm"] != ""))
        value = F.filter(tokens, lambda t: (t["x"] >= edge["since"]) & (t["x"] < edge["high"]))
        return once(labels, lambda n: once(value, lambda v: F.struct(
            column["column_index"].alias("column_index"), band.cast("int").alias("band"), n["text"].alias("texts"), n["norm"].alias("norms"), n["y"].alias("tops"), n["bottom"].alias("bottoms"),
            F.when(F.size(v) > 0, joined(v["text"])).alias("raw"), average(v["confidence"]).alias("token_conf"), F.get(v, F.lit(0))["x"].alias("first_x"),
        )))

    def lines(column: Column, edge: Column) -> Column:
        reach = F.filter(F.col("inside"), lambda t: (t["right"] >= edge["low"]) & (t["x"] < edge["high"]))
        return islands(reach, "center_y", F.lit(options.row_band) * F.col("page_height"), lambda b, k: once(across(b), lambda tokens: line(column, k, edge, tokens)))

    def values(edge: Column) -> Column:
        at = F.filter(F.col("tokens"), lambda t: t["center_x"].between(edge["left"], edge["right"]))
        return F.sort_array(F.transform(at, lambda t: F.struct(*(t[c].alias(c) for c in ("x", "ord", "center_y", "text", "confidence")))))

    some = F.filter(F.flatten(F.transform("columns", lambda c: once(edges(c), lambda e: lines(c, e)))), lambda x: F.size(x["norms"]) > 0)
    sides = F.transform("columns", lambda c: F.struct(*(c[n].alias(n) for n in ("colon_x", "column_right", "fallback")), once(edges(c), values).alias("values")))
    return computed(pages, {"lines": some, "columns": sides})
