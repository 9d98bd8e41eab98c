"""What is extracted, and the tolerances it is found with."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDINAL = "#N"


class Field(NamedTuple):
    name: str
    patterns: tuple[tuple[str, ...], ...]
    label: str
    kind: str
    low: str | None = None
    high: str | None = None
    longest: int | None = None


#: The fields in order, their labels, kinds and plausible ranges.
FIELDS = (
    Field("NUM_CILINDROS", ((ORDINAL, "cilindros"),), "N° Cilindros", "int", "1", "24"),
    Field("PESO_NETO", (("peso", "neto"),), "Peso Neto", "decimal", "0.001", "200"),
    Field("PESO_BRUTO", (("peso", "bruto"),), "Peso Bruto", "decimal", "0.001", "200"),
    Field("NUM_ASIENTOS", ((ORDINAL, "asientos"),), "N° Asientos", "int", "1", "120"),
    Field("NUM_PASAJEROS", ((ORDINAL, "pasajer"),), "N° Pasajer.", "int", "0", "120"),
    Field("NUM_EJES", ((ORDINAL, "ejes"),), "N° Ejes", "int", "1", "12"),
    Field("NUM_RUEDAS", ((ORDINAL, "ruedas"),), "N° Ruedas", "int", "1", "40"),
    Field("LONGITUD", (("longitud",),), "Longitud", "decimal", "0.001", "40"),
    Field("ANCHO", (("ancho",),), "Ancho", "decimal", "0.001", "10"),
    Field("ALTURA", (("altura",),), "Altura", "decimal", "0.001", "10"),
    Field("NUM_PARTIDA", ((ORDINAL, "partida"),), "N° Partida", "string", longest=32),
    Field("TIPO_USO", (("tipo", "uso"), ("tipo", "de", "uso")), "Tipo Uso", "string", longest=120),
)
#: Read only to compare the document's plate with the requested one.
PLATE = Field("PLACA", (("placa",),), "Placa", "string")
NAMES = [f.name for f in FIELDS]
#: Words that open and close the section, and columns of a page where none are found, by width.
HEADER, FOOTERS = "caracteristicas", ("afectaciones", "titulos")
FALLBACK_COLUMNS = ((0.0336, 0.1357, 0.1437), (0.3538, 0.4567, 0.4647), (0.6756, 0.7912, 0.7992))


@dataclass(frozen=True)
class Options:
    """Tolerances as shares of the page's width or height, and thresholds of matching and admission."""

    colon_cluster: float = 0.030
    row_band: float = 0.008
    anchor: float = 0.006
    cell_inset: float = 0.007
    right_margin: float = 0.006
    column_inset: float = 0.01
    run_gap_glyphs: float = 2.6
    fallback_height: float = 0.30
    cell_pad: float = 0.55
    fuzzy_ratio: float = 0.85
    fuzzy_length: int = 6
    native_words: int = 40
    ocr_pages: int = 3
    probe_scale: float = 1.5
    glyph_height: float = 26.0
    scales: tuple[float, float] = (1.5, 4.0)
    rescale_from: float = 0.25
    max_bytes: int = 25 * 1024 * 1024
    mask_strings: bool = False
    debug: bool = False


def pixels(share: float, size: str) -> Column:
    """A share of the page in whole pixels, cut off."""
    return (F.lit(float(share)) * F.col(size)).cast("int")


#: Error codes, their HTTP status and message.
ERRORS = {
    "INVALID_REQUEST": (422, "The request payload is invalid."),
    "UNAUTHORIZED": (401, "Missing or invalid API key."),
    "DRIVE_FILE_NOT_FOUND": (404, "The requested Drive file does not exist."),
    "DRIVE_PERMISSION_DENIED": (403, "The service account cannot read the requested Drive file."),
    "INVALID_DOCUMENT_TYPE": (415, "Expected a PDF document."),
    "FILE_TOO_LARGE": (413, "The document exceeds the configured size limit."),
    "PDF_INVALID": (422, "The downloaded file could not be opened as a PDF."),
    "TARGET_SECTION_NOT_FOUND": (422, "The 'Caracteristicas del Vehiculo' section could not be located."),
    "OCR_TIMEOUT": (504, "OCR did not finish within the configured timeout."),
    "OCR_FAILED": (500, "OCR failed to process the document."),
    "DOCUMENT_PROCESSING_FAILED": (500, "The document could not be processed."),
    "INTERNAL_ERROR": (500, "An unexpected error occurred."),
}
#: The code of a bare HTTP status.
STATUS_CODES = {401: "UNAUTHORIZED", 403: "UNAUTHORIZED", 404: "NOT_FOUND", 405: "INVALID_REQUEST"}
