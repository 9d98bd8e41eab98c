"""JSON bodies whose shape is not known beforehand, as variants: each is parsed once, and read at any of several paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the code and the message of an error may stand in a body.
CODES = ("$.error.code", "$.detail.error.code", "$.body.error.code", "$.code")
SAID = ("$.error.message", "$.detail.error.message", "$.body.error.message", "$.message", "$.detail")


def parsed(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects): df with `value`, the body as a variant, and the rows whose body is missing, malformed, or has a key
    twice, with their error code. A bad body never fails the job."""
    judged = df.withColumn("value", F.try_parse_json(F.col(body)))
    good = judged.where("value is not null")
    return good, judged.where("value is null").drop("value").withColumn("error_code", F.lit("INVALID_REQUEST"))


def text_of(value: Column, paths: tuple[str, ...]) -> Column:
    """The first of the paths that holds a text; objects and numbers are none."""
    is_text = lambda p: F.schema_of_variant(F.try_variant_get(value, p, "variant")) == "STRING"
    return F.coalesce(*(F.when(is_text(p), F.try_variant_get(value, p, "string")) for p in paths))


def outcomes(good: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows of good with `state` (success or error), the error's code and message, and the named values as they are written:
    numbers and texts alike, null where a body lacks them. An error without a known code is an internal one."""
    v = F.col("value")
    failed = text_of(v, CODES).isNotNull() | ~F.coalesce(F.try_variant_get(v, "$.status", "string") == "success", F.lit(False))
    code = F.when(failed, F.coalesce(text_of(v, CODES), F.lit("INTERNAL_ERROR")))
    values = [F.when(~failed, F.try_variant_get(v, f"$.values.{n}", "string")).alias(n) for n in names]
    kept = [c for c in good.columns if c != "value"]
    return good.select(*kept, F.when(failed, "error").otherwise("success").alias("state"), code.alias("code"), F.when(failed, text_of(v, SAID)).alias("message"), *values)
