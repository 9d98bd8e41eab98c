"""Files, requests and their admission, and an optional reader of PDF files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem, normalize_plate
from ..plans.spec import Options

REQUEST = "row_number int, plate string, drive_file_id string"
PDF = "application/pdf"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, name, mime_type, size, modified_time, content) of the files in a folder. A plan that does not use the
    content does not read it."""
    f = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.lower(name).endswith(".pdf"), PDF).otherwise("application/octet-stream")
    return f.select(file_stem(name).alias("id"), name.alias("name"), kind.alias("mime_type"), F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("modified_time"), "content")


def admission_error(mime_type: Column, size: Column, options: Options = Options()) -> Column:
    """The error a file is turned away with, or null: its type counts before its size, and an unknown size passes."""
    return F.when(~mime_type.eqNullSafe(F.lit(PDF)), "INVALID_DOCUMENT_TYPE").when(size > options.max_bytes, "FILE_TOO_LARGE")


def request_error(plate: Column, file_id: Column) -> Column:
    sound = F.length(plate).between(1, 32) & (normalize_plate(plate) != "") & file_id.rlike(r"^[A-Za-z0-9_\-]{10,256}$")
    return F.when(~F.coalesce(sound, F.lit(False)), "INVALID_REQUEST")


def requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Requests from JSON bodies, with `error_code` for those with missing, odd or further keys."""
    r = bodies.withColumn("_r", F.from_json(body, "plate string, drive_file_id string")).withColumn("_keys", F.json_object_keys(body))
    extra = F.size(F.array_except(F.coalesce("_keys", F.array(F.lit("?"))), F.array(F.lit("plate"), F.lit("drive_file_id")))) > 0
    error = F.when(extra, "INVALID_REQUEST").otherwise(request_error(F.col("_r.plate"), F.col("_r.drive_file_id")))
    return r.select(*bodies.columns, "_r.plate", "_r.drive_file_id", error.alias("error_code"))


def admitted(wanted: DataFrame, meta: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejects) of requests joined with file metadata, before any content is read."""
    joined = wanted.join(meta.drop("content").withColumnRenamed("id", "drive_file_id").withColumn("_known", F.lit(True)), "drive_file_id", "left")
    error = F.when(F.col("_known").isNull(), "DRIVE_FILE_NOT_FOUND").otherwise(admission_error(F.col("mime_type"), F.col("size"), options))
    judged = joined.withColumn("error_code", error).drop("_known")
    return judged.where("error_code is null").drop("error_code"), judged.where("error_code is not null")


def rechecked(content: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects) of files by the bytes that are really there, whatever their metadata said; a missing content is no
    document. Rejects carry no content."""
    size = F.octet_length("content")
    judged = content.withColumn("error_code", F.when(F.col("content").isNull(), "DRIVE_FILE_NOT_FOUND").when(size > options.max_bytes, "FILE_TOO_LARGE"))
    return judged.where("error_code is null").drop("error_code"), judged.where("error_code is not null").drop("content")


def pdf_words(content: DataFrame) -> DataFrame:
    """Words of the text layer of PDF files (doc_id, content), by an optional library: rows as native_tokens takes them,
    and one with an error for each file that cannot be opened or has no page."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        try:
            import fitz
        except ImportError as missing:
            raise RuntimeError("reading PDF files needs the optional package PyMuPDF; give tokens as a table instead") from missing
        columns = ["doc_id", "page", "ord", "text", "x0", "y0", "x1", "y1", "error_code"]
        for batch in batches:
            rows = []
            for key, data in zip(batch["doc_id"], batch["content"]):
                try:
                    with fitz.open(stream=data, filetype="pdf") as document:
                        if not document.page_count:
                            raise ValueError("no page")
                        rows += [(key, page.number, k, w[4], *w[:4], None) for page in document for k, w in enumerate(page.get_text("words"))]
                except Exception:  # noqa: BLE001  one unreadable file is a reject, not a failed job
                    rows.append((key, None, None, None, None, None, None, None, "PDF_INVALID"))
            yield pd.DataFrame(rows, columns=columns)

    return content.select("doc_id", "content").mapInPandas(read, "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, error_code string")
