"""From tokens to field rows, ordered warnings, values and JSON. No document fails the job: those that cannot be read
are rows of `rejects`."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import plates_match
from ..functions.text import normalize_plate, number_json
from ..operators.aggregates import ordered_text, pivoted
from ..operators.tables import merged_in, stored
from . import geometry, matching, reading
from .spec import NAMES, Options

#: What each warning says. {0} is the field, {1} what was read.
MESSAGES = {
    "LABEL_MISSING": "Label for {0} was not found in the section.",
    "FIELD_NOT_FOUND": "No value could be located for {0}.",
    "FIELD_UNAVAILABLE": "{0} is redacted in the document and was not inferred.",
    "UNPARSEABLE_VALUE": "The value read for {0} could not be parsed and was not guessed.",
    "VALIDATION_FAILED": "{0} failed its plausibility check and was returned unmodified.",
    "LOW_CONFIDENCE_FIELD": "The two independent reads of {0} disagreed.",
    "LABEL_FUZZY_MATCH": "The label for {0} was overlapped by neighbouring text and recovered by approximate matching (read as '{1}').",
    "WEIGHTS": "PESO_BRUTO is lower than PESO_NETO; both values are reported as read.",
    "SECTION_FALLBACK_USED": "The section header was not found; the whole page was searched instead.",
    "PLATE_MISMATCH": "The document's plate ({0}) differs from the requested plate ({1}).",
}


class Extraction:
    """What a run gives. Documents and warnings are only made, once, where they are asked for."""

    def __init__(self, results: DataFrame, documents: Callable[[], DataFrame], warnings: Callable[[DataFrame], DataFrame]):
        self.results, self._documents, self._warnings = results, documents, warnings

    @cached_property
    def documents(self) -> DataFrame:
        return merged_in(stored(self._documents(), "documents"))

    @cached_property
    def warnings(self) -> DataFrame:
        return merged_in(stored(self._warnings(self.documents), "warnings"))


def message(code: Column, first: Column, second: Column | str = "") -> Column:
    text = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), code)
    return F.replace(F.replace(text, F.lit("{0}"), first), F.lit("{1}"), second if isinstance(second, Column) else F.lit(second))


def extract(tokens: DataFrame, pages: DataFrame, requests: DataFrame | None = None, reads: DataFrame | None = None, options: Options = Options()) -> Extraction:
    """tokens (doc_id, ord, text, x, y, width, height, confidence) of the chosen page (doc_id, width, height) of each
    document; requests (doc_id, plate) to compare plates with; reads are second readings, see reading.cell_reads."""
    # What several later steps read is a table: recomputing it in each would multiply the plan. A row holds a whole page, so no
    # step but the first shuffles tokens; what has rows of every document is merged in joins.
    kept = lambda df, name: merged_in(stored(df, name))
    whole = geometry.placed(merged_in(tokens), merged_in(pages))
    if reads is not None:
        given = reads.groupBy("doc_id").agg(F.collect_list(F.struct("y_center", "crop_text", "crop_conf")).alias("reads"))
        whole = whole.join(merged_in(given), "doc_id", "left")
    section = geometry.section_tokens(whole, options)
    # Of a page only its section's text and the lines of its columns are needed from here on.
    cells = geometry.cells(geometry.ruled(section, options), options)
    cells = kept(cells.withColumn("section_text", geometry.section_text(F.col("inside"))).drop("tokens", "inside"), "cells")
    both = kept(reading.both_reads(matching.located(cells, options), reads is not None, options), "reads")
    results = reading.resolved(both.where(F.col("field").isin(NAMES)), options).select(
        "doc_id", "field", "spec_ord", "kind", "value_text", "value_number", "status", "ocr_confidence", "valid", "source_label", "matched", "codes"
    )
    results = kept(results, "results")

    def documents() -> DataFrame:
        some = F.col("section_text").isNotNull()
        own = cells.select(
            "doc_id", "section_top", "section_bottom", "header_found", *(F.when(some, F.col(c)).alias(c) for c in ("page_width", "page_height")),
            F.exists("columns", lambda c: c["fallback"]).alias("used_fallback_columns"), "section_text",
        )
        plates = both.where("field = 'PLACA'").select("doc_id", F.nullif("token_text", F.lit("")).alias("plate_in_document"))
        counts = results.groupBy("doc_id").agg(F.count_if(F.col("status") == "extracted").alias("found_count"))
        for part in (plates, counts):
            own = own.join(part, "doc_id", "left")
        return own.select("doc_id", "section_top", "section_bottom", "header_found", "page_width", "page_height", "used_fallback_columns", "plate_in_document", "found_count", "section_text")

    def warnings(documents: DataFrame) -> DataFrame:
        nothing = F.lit(None).cast("string").alias("field")
        own = results.select("doc_id", "field", "spec_ord", "matched", "source_label", F.posexplode("codes").alias("k", "code"))
        said = F.when((F.col("code") == "FIELD_NOT_FOUND") & F.col("source_label").isNull(), "LABEL_MISSING").otherwise(F.col("code"))
        out = own.select("doc_id", (F.col("spec_ord") * 10 + F.col("k") + 10).alias("ord"), "code", message(said, F.col("field"), F.coalesce("matched", F.lit(""))).alias("message"), "field")
        weights = pivoted(results, ["doc_id"], "field", "value_number", ["PESO_NETO", "PESO_BRUTO"]).where("PESO_BRUTO < PESO_NETO")
        out = out.unionByName(weights.select("doc_id", F.lit(1000).alias("ord"), F.lit("VALIDATION_FAILED").alias("code"), F.lit(MESSAGES["WEIGHTS"]).alias("message"), F.lit("PESO_BRUTO").alias("field")))
        whole = documents.where(~F.coalesce("header_found", F.lit(False))).select("doc_id", F.lit(0).alias("ord"), F.lit("SECTION_FALLBACK_USED").alias("code"), F.lit(MESSAGES["SECTION_FALLBACK_USED"]).alias("message"), nothing)
        out = out.unionByName(whole)
        if requests is not None:
            asked = normalize_plate(F.col("plate"))
            other = documents.where("plate_in_document is not null").join(requests.select("doc_id", "plate"), "doc_id").where(~plates_match(F.col("plate_in_document"), F.col("plate")))
            out = out.unionByName(other.select("doc_id", F.lit(2000).alias("ord"), F.lit("PLATE_MISMATCH").alias("code"), message(F.lit("PLATE_MISMATCH"), normalize_plate(F.col("plate_in_document")), asked).alias("message"), nothing))
        return out

    return Extraction(results, documents, warnings)


def values(results: DataFrame) -> DataFrame:
    """One row per document with a column for each field: its value as text, null where there is none."""
    return results.groupBy("doc_id").agg(*(F.first(F.when(F.col("field") == n, F.col("value_text")), ignorenulls=True).alias(n) for n in NAMES))


def rejects(documents: DataFrame) -> DataFrame:
    """Documents in which no field was found, with their error code. Implausible values count as found."""
    return documents.where(F.coalesce("found_count", F.lit(0)) == 0).select("doc_id", F.lit("TARGET_SECTION_NOT_FOUND").alias("error_code"))


def responses(e: Extraction, options: Options = Options()) -> DataFrame:
    """Rows (doc_id, json): status, values, fields and ordered warnings, nulls included; `debug` only if it is asked for."""
    number = F.when(F.col("kind") == "string", F.to_json(F.array("value_text")).substr(F.lit(2), F.length(F.to_json(F.array("value_text"))) - 2)).otherwise(number_json(F.col("value_number")))
    value = F.coalesce(number, F.lit("null"))
    detail = F.to_json(F.struct("status", "ocr_confidence", "valid", "source_label"), {"ignoreNullFields": "false"})
    quoted = F.concat(F.lit('"'), F.col("field"), F.lit('":'))
    field = F.concat(quoted, F.lit('{"value":'), value, F.lit(","), F.expr("substring(detail, 2)"))
    per = e.results.withColumn("detail", detail).select("doc_id", "spec_ord", F.concat(quoted, value).alias("v"), field.alias("f"))
    fields = per.groupBy("doc_id").agg(ordered_text("v", ["spec_ord"], ",").alias("v"), ordered_text("f", ["spec_ord"], ",").alias("f"))
    warned = e.warnings.withColumn("w", F.to_json(F.struct("code", "message", "field"), {"ignoreNullFields": "false"})).groupBy("doc_id").agg(ordered_text("w", ["ord", "code"], ",").alias("w"))
    whole = e.documents.join(fields, "doc_id").join(warned, "doc_id", "left").join(rejects(e.documents).select("doc_id", "error_code"), "doc_id", "left").where("error_code is null")
    parts = [F.lit('{"status":"success","values":{'), F.col("v"), F.lit('},"fields":{'), F.col("f"), F.lit('},"warnings":['), F.coalesce("w", F.lit("")), F.lit("]")]
    if options.debug:
        parts += [F.lit(',"debug":'), F.to_json(F.struct("section_top", "section_bottom", "section_text", "plate_in_document"), {"ignoreNullFields": "false"})]
    return whole.select("doc_id", F.concat(*parts, F.lit("}")).alias("json"))
