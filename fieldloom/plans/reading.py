"""Two readings of each located field, and the one value they give. Values are never invented or averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import case_fold, collapse_spaces, decimal_text, int_text, looks_masked, strip_leading_separator, trim_spaces
from ..operators.nested import average, joined, once
from .matching import SOUGHT
from .spec import FIELDS, Options, pixels


def both_reads(located: DataFrame, given: bool = False, options: Options = Options()) -> DataFrame:
    """Rows (doc_id, spec_ord, field, kind, label, found, tier, matched, token_text, token_conf, crop_text, crop_conf) for each
    sought field of each page, found or not. The first reading are the row's tokens from the colon on: where no separator
    survived but the first token starts on the colon's place, its first glyph is the colon and goes. The second are the
    tokens with their centre in the cell, right of the colon and somewhat higher than the label, or, where they are given,
    the first of the page's `reads` (y_center, crop_text, crop_conf) whose height is in it."""
    sought = F.array(*(F.struct(F.lit(k).alias("spec_ord"), *(F.lit(v).alias(n) for n, v in (("field", f.name), ("kind", f.kind), ("label", f.label)))) for k, f in enumerate(SOUGHT)))

    def own(f: Column, label: Column, line: Column, column: Column) -> Column:
        pad = F.greatest(F.lit(6), (F.lit(options.cell_pad) * (label["label_bottom"] - label["label_top"])).cast("int"))
        known = lambda y: F.when(label["at"].isNotNull(), y)
        top, bottom = known(F.greatest(F.lit(0), label["label_top"] - pad)), known(F.least("page_height", label["label_bottom"] + pad))
        at = lambda y, box: y.between(box["top"], box["bottom"])
        crop = lambda box: F.filter(column["values"], lambda t: at(t["center_y"], box))
        read = lambda box: F.array_min(F.filter(F.col("reads"), lambda r: at(r["y_center"], box))) if given else F.lit(None).cast("struct<y_center:int,crop_text:string,crop_conf:double>")
        cut = once(F.struct(top.alias("top"), bottom.alias("bottom")), lambda box: F.struct(crop(box).alias("tokens"), read(box).alias("given")))
        return once(cut, lambda c: F.struct(
            *(f[n].alias(n) for n in ("spec_ord", "field", "kind", "label")), label["tier"].alias("tier"), label["matched"].alias("matched"), line["raw"].alias("raw"), line["token_conf"].alias("token_conf"),
            (line["first_x"] - column["colon_x"]).alias("off"), joined(c["tokens"]["text"]).alias("crop"), average(c["tokens"]["confidence"]).alias("own_conf"), c["given"].alias("given"),
        ))

    def each(f: Column, k: Column) -> Column:
        line = lambda label: F.get("lines", label["at"])
        return once(F.get("labels", k), lambda label: once(line(label), lambda x: own(f, label, x, F.get("columns", x["column_index"]))))

    rows = located.select("doc_id", pixels(options.anchor, "page_width").alias("tol"), F.inline(F.transform(sought, each)))
    raw = trim_spaces(F.col("raw"))
    clean = strip_leading_separator(F.col("raw"))
    fused = (clean == F.col("raw")) & (F.abs("off") <= F.col("tol")) & (F.length("raw") > 1)
    token = F.when(fused, strip_leading_separator(F.expr("substring(raw, 2)"))).otherwise(clean)
    second, is_given = strip_leading_separator(F.regexp_replace("crop", "^[: ]+", "")), F.col("given").isNotNull()
    return rows.withColumn("raw", raw).select(
        "doc_id", "spec_ord", "field", "kind", "label", F.col("tier").isNotNull().alias("found"), "tier", "matched", token.alias("token_text"), "token_conf",
        F.when(is_given, strip_leading_separator(F.col("given.crop_text"))).otherwise(second).alias("crop_text"), F.when(is_given, F.col("given.crop_conf")).otherwise(F.col("own_conf")).alias("crop_conf"),
    )


def value_text(text: Column, kind: Column) -> Column:
    """The value a text holds, as written, by kind; null where it holds none."""
    words = F.nullif(collapse_spaces(text), F.lit(""))
    return F.when(kind == "int", int_text(text)).when(kind == "decimal", decimal_text(text)).otherwise(words)


def plausible(field: Column, kind: Column, value: Column) -> Column:
    low, high, longest = (F.element_at(F.create_map(*[F.lit(y) for f in FIELDS for y in (f.name, x(f))]), field) for x in (lambda f: f.low, lambda f: f.high, lambda f: f.longest))
    number = value.try_cast("decimal(38,18)")
    # A number too long for the type is beyond every range.
    in_range = F.coalesce((number >= low.cast("decimal(38,18)")) & (number <= high.cast("decimal(38,18)")), F.lit(False))
    packed = F.replace(value, F.lit(" "), F.lit(""))
    entry = packed.rlike(r"(?U)^\p{Alnum}+\z") & packed.rlike(r"(?U)\d") & (F.length(packed) >= 4)
    words = F.when(field == "NUM_PARTIDA", entry).otherwise(F.length(trim_spaces(value)) >= 2)
    return F.when(kind == "string", (F.length(value) <= longest) & words).otherwise(in_range)


def resolved(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """reads (with field, kind, label, found and both readings) with value_text, status, ocr_confidence, valid and codes."""
    kind, field = F.col("kind"), F.col("field")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = reads.withColumns({"token_text": text("token_text"), "crop_text": text("crop_text")})
    # Both readings go through the same rules, as items: written out twice these are too much code for one compiled method.
    read = lambda t: F.struct(value_text(t["text"], kind).alias("value"), looks_masked(t["text"], t["conf"]).alias("masked"))
    each = F.array(*(F.struct(F.col(f"{c}_text").alias("text"), F.col(f"{c}_conf").alias("conf")) for c in ("token", "crop")))
    r = r.withColumn("_read", F.transform(each, read))
    r = r.withColumns({"_a": F.col("_read")[0]["value"], "_b": F.col("_read")[1]["value"], "_masked": F.col("_read")[0]["masked"] | F.col("_read")[1]["masked"]})
    if options.mask_strings:
        r = r.withColumns({c: F.when(F.col("_masked") & (kind == "string"), F.lit(None)).otherwise(F.col(c)) for c in ("_a", "_b")})
    a, b = F.col("_a"), F.col("_b")
    fold = lambda c: F.when(kind == "string", case_fold(c)).otherwise(c)
    both = a.isNotNull() & b.isNotNull()
    agree, differ = both & (fold(a) == fold(b)), both & (fold(a) != fold(b))
    rank = lambda v, c: F.struct(plausible(field, kind, v).alias("ok"), F.coalesce(F.col(c), F.lit(-1.0)).alias("conf"))
    second = a.isNull() & b.isNotNull() | differ & (rank(b, "crop_conf") > rank(a, "token_conf"))
    value = F.when(second, b).otherwise(a)
    conf = F.when(agree, F.greatest("token_conf", "crop_conf")).when(second, F.col("crop_conf")).otherwise(F.col("token_conf"))
    r = r.withColumns({"value_text": value, "_differ": differ, "_conf": conf})
    has = F.col("value_text").isNotNull()
    r = r.withColumns({
        "status": F.when(has, "extracted").when(F.col("found") & F.col("_masked"), "unavailable").otherwise("not_found"),
        "ocr_confidence": F.when(has, F.col("_conf")),
        "valid": F.when(has, plausible(field, kind, F.col("value_text"))),
        "value_number": F.when(kind != "string", F.col("value_text").try_cast("decimal(38,18)")),
        "source_label": F.when(F.col("found"), F.col("label")),
    })
    silent = (F.col("token_text") == "") & (F.col("crop_text") == "")
    codes = [
        F.when(F.col("tier") == 3, "LABEL_FUZZY_MATCH"),
        F.when(has & F.col("_differ"), "LOW_CONFIDENCE_FIELD"),
        F.when(~has & (F.col("status") == "unavailable"), "FIELD_UNAVAILABLE"),
        F.when(~has & (F.col("status") == "not_found"), F.when(silent, "FIELD_NOT_FOUND").otherwise("UNPARSEABLE_VALUE")),
        F.when(has & ~F.col("valid"), "VALIDATION_FAILED"),
    ]
    return r.withColumn("codes", F.array_compact(F.array(*codes))).drop("_read", "_a", "_b", "_masked", "_differ", "_conf")
