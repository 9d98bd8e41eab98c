"""What happened, as JSON lines with secrets hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact

#: Names whose values are never written.
HIDDEN = ["api_key", "x-api-key", "authorization", "credentials", "google_application_credentials", "token", "raw_text", "ocr_text"]


def event_lines(df: DataFrame, ts: Column, level: Column, logger: Column, event: Column, request_id: Column, fields: Column) -> DataFrame:
    """Rows (value): one JSON object per row, the fields (a map of text) beside the fixed members, null ones included. A
    field that has the name of a fixed member is left out."""
    fixed = F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssZ").alias("ts"), level.alias("level"), logger.alias("logger"), event.alias("event"), request_id.alias("request_id")), {"ignoreNullFields": "false"})
    more = F.map_filter(redact(fields, HIDDEN), lambda k, v: ~k.isin("ts", "level", "logger", "event", "request_id"))
    more = F.to_json(more, {"ignoreNullFields": "false"})
    both = F.concat(F.expr("left(fixed, length(fixed) - 1)"), F.lit(","), F.expr("substring(more, 2)"))
    return df.select(fixed.alias("fixed"), more.alias("more")).select(F.when(F.coalesce(F.length("more"), F.lit(2)) <= 2, F.col("fixed")).otherwise(both).alias("value"))


def write_events(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)
