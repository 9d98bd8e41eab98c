"""Errors as rows: every code has an HTTP status and a message, and no row fails a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spec import ERRORS, STATUS_CODES


def described(df: DataFrame, code: str = "error_code") -> DataFrame:
    """df with http_status and message of its codes: a code that is not known is an internal error, and no code is no
    error. The table of codes is a constant, so nothing is joined."""
    known = F.create_map(*[F.lit(x) for k in ERRORS for x in (k, k)])
    own = F.coalesce(F.try_element_at(known, F.col(code)), F.lit("INTERNAL_ERROR"))
    status = F.create_map(*[F.lit(x) for k, (n, _) in ERRORS.items() for x in (k, n)])
    text = F.create_map(*[F.lit(x) for k, (_, m) in ERRORS.items() for x in (k, m)])
    some = F.col(code).isNotNull()
    return df.withColumns({"http_status": F.when(some, F.element_at(status, own)), "message": F.when(some, F.element_at(text, own))})


def code_of_status(status: Column) -> Column:
    """The code of a bare HTTP status; an unlisted one is an internal error."""
    listed = F.create_map(*[F.lit(x) for kv in STATUS_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(listed, status), F.lit("INTERNAL_ERROR"))


def error_json(code: Column, message: Column, request_id: Column) -> Column:
    """The body of an error response."""
    error = F.struct(code.alias("code"), message.alias("message"))
    return F.to_json(F.struct(F.lit("error").alias("status"), error.alias("error"), request_id.alias("request_id")), {"ignoreNullFields": "false"})
