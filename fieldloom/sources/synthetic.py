"""Synthetic forms for tests and demonstrations, made from the rows of any table.

A form is a table of cells, one row for each label and its value; laid_out turns cells into positioned tokens. Both are
column expressions, so a form for each row of a large table is made where the row is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import FALLBACK_COLUMNS

CELLS = "doc_id string, col int, line int, label string, value string, joined boolean, confidence double, cover string"
#: The page, the width of a glyph and of a space, the height of a token, and where the lines are.
WIDTH, HEIGHT, GLYPH, SPACE, TALL = 2100, 2900, 15, 18, 24
TOP, FIRST_LINE, LEADING, LINES = 700, 780, 50, 6
#: Where labels, colons and values of the three columns begin: at the usual shares of the width.
PLACES = tuple(tuple(round(share * WIDTH) for share in column) for column in FALLBACK_COLUMNS)
CONFIDENCE = 91.5

#: The cells of a form by column: the label, and its value as an expression of the key k.
FORM = (
    (
        ("Placa", "concat('T', lpad(k % 1000, 3, '0'), 'R')"),
        ("Tipo Uso", "element_at(array('Reparto local', 'Servicio escolar', 'Carga regional'), int(k % 3 + 1))"),
        ("Longitud", "concat(k % 7 + 4, '.', k % 80 + 10)"),
        ("Ancho", "concat(k % 3 + 1, '.', k % 70 + 20)"),
        ("Altura", "concat(k % 4 + 1, '.', k % 60 + 30)"),
        ("Sede", "concat('Oficina ', k % 9)"),
    ),
    (
        ("Peso Neto", "concat(k % 20 + 1, '.', k % 9 + 1)"),
        ("Peso Bruto", "concat(k % 20 + 21, '.', k % 9 + 1)"),
        ("N° Cilindros", "string(k % 8 + 3)"),
        ("Tono", "'Gris'"),
        ("N° Pasajer.", "string(k % 60 + 1)"),
        ("N° Asientos", "string(k % 60 + 2)"),
    ),
    (
        ("N° Ejes", "string(k % 5 + 2)"),
        ("N° Ruedas", "string(2 * (k % 5 + 2))"),
        ("N° Partida", "concat('E', lpad(k, 7, '0'))"),
        ("Emisión", "'Segunda'"),
        ("Folio", "string(k % 500 + 1)"),
        ("Zona", "'Norte'"),
    ),
)


def forms(rows: DataFrame, key: str) -> DataFrame:
    """The cells of one form for each row, whose id is its key; `k` stays for further changes."""
    each = [
        F.struct(F.lit(c).alias("col"), F.lit(line).alias("line"), F.lit(label).alias("label"), F.expr(value).alias("value"))
        for c, column in enumerate(FORM)
        for line, (label, value) in enumerate(column)
    ]
    # Keys are dealt over the tasks before each becomes a form, as a small file of keys is read by one task; by document, so that
    # their tokens need no shuffle.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = rows.select(F.col(key).cast("string").alias("doc_id"), F.col(key).cast("long").alias("k")).repartition(n, "doc_id")
    return k.select("doc_id", "k", F.inline(F.array(*each))).withColumns(
        {"joined": F.lit(False), "confidence": F.lit(CONFIDENCE), "cover": F.lit(None).cast("string")}
    )


def laid_out(cells: DataFrame, headed: Column | bool = True, colons: Column | bool = True) -> DataFrame:
    """The tokens of forms (see CELLS). A joined cell has its colon and value in one token; a cover is a token printed over a
    label, up to just before the colon. `headed` and `colons` tell of each cell's document whether it has header and footer,
    and colons."""
    say = lambda c: F.lit(c) if isinstance(c, bool) else c
    place = [F.element_at(F.array(*(F.lit(p[k]) for p in PLACES)), F.col("col") + 1) for k in range(3)]
    confidence, joined, covered = F.col("confidence"), F.col("joined"), F.col("cover").isNotNull()
    line = F.lit(FIRST_LINE) + LEADING * F.col("line")

    def text(nth: int, said: Column, x: Column, conf: Column | float | None, y: Column | int = line, apart: bool = True) -> Column:
        """Words that begin at x, or with apart=False one token; where they are null there is nothing."""
        conf, y = (v if isinstance(v, Column) else F.lit(v) for v in (conf, y))
        return F.struct(F.lit(nth).alias("first"), said.alias("said"), x.cast("int").alias("left"), y.cast("int").alias("y"), conf.cast("double").alias("confidence"), F.lit(apart).alias("apart"))

    # Header and footer come with the first cell of a form.
    around = [("Características", 75, TOP), ("técnicas", 340, TOP), ("Títulos", 75, FIRST_LINE + LEADING * (LINES + 1)), ("anotados", 210, FIRST_LINE + LEADING * (LINES + 1))]
    first = say(headed) & (F.col("col") == 0) & (F.col("line") == 0)
    texts = [
        text(0, F.when(~covered, F.col("label")), place[0], CONFIDENCE), text(0, F.col("cover"), place[1] - 24 - GLYPH * F.length("cover"), 20.0, apart=False),
        text(20, F.when(say(colons) & ~joined, ":"), place[1], None), text(20, F.when(joined, F.concat(F.lit("8"), F.col("value"))), place[1], confidence, apart=False),
        text(30, F.when(~joined, F.col("value")), place[2], confidence), *(text(90 + k, F.when(first, t), F.lit(x), CONFIDENCE, y) for k, (t, x, y) in enumerate(around)),
    ]
    printed = cells.select("doc_id", F.col("col").alias("_c"), F.col("line").alias("_l"), F.inline(F.array(*texts))).where("said is not null")
    # Words are apart by one space, so what is passed before a word can be told from their number and the text up to it.
    said = F.col("said")
    spaced = F.col("apart") & (said.contains("  ") | said.startswith(" ") | said.endswith(" "))
    printed = printed.withColumn("said", F.when(spaced, F.trim(F.regexp_replace("said", " +", " "))).otherwise(said))
    words = printed.select("*", F.posexplode(F.when(F.col("apart"), F.split("said", " ")).otherwise(F.array("said"))).alias("k", "text")).where("text <> ''")
    passed = F.when(F.col("k") > 0, GLYPH * (F.length(F.expr("substring_index(said, ' ', k)")) - F.col("k") + 1) + SPACE * F.col("k")).otherwise(0)
    tokens = words.withColumns({"nth": F.col("first") + F.col("k"), "x": F.col("left") + passed})
    return tokens.select(
        "doc_id", F.lit(1).alias("page"), F.lit("ocr").alias("source_kind"), (1000 * F.col("_c") + 100 * F.col("_l") + F.col("nth")).alias("ord"), "text", "x", "y",
        (GLYPH * F.length("text")).alias("width"), F.lit(TALL).alias("height"), "confidence",
    )


def sheets(rows: DataFrame, key: str) -> DataFrame:
    """The page of each form."""
    return rows.select(F.col(key).cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def plain_forms(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tokens and pages of forms in which every field can be read."""
    return laid_out(forms(rows, key)), sheets(rows, key)


def odd_forms(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tokens and pages of forms of which the key's last digit says what is odd: 1 two colons joined with their values, 2 a
    masked weight, 3 a missing line, 4 a covered label, 5 an implausible number, 6 no header, 7 a number in words, 8 no colons,
    9 a decimal comma and a gross weight below the net one, 0 nothing."""
    digit, label = F.col("k") % 10, F.col("label")
    is_ = lambda n, *names: (digit == n) & label.isin(*names)
    masked = is_(2, "Peso Neto")
    value = F.when(masked, "########").when(is_(5, "N° Ejes"), "0").when(is_(7, "N° Ejes"), "varios").when(is_(9, "Peso Neto"), "9,5").when(is_(9, "Peso Bruto"), "1.25").otherwise(F.col("value"))
    cells = forms(rows, key).where(~is_(3, "Ancho")).withColumns({
        "value": value,
        "joined": is_(1, "N° Ejes", "N° Ruedas"),
        "confidence": F.when(masked, 0.0).otherwise(F.col("confidence")),
        "cover": F.when(is_(4, "N° Asientos"), "VERDEAsiemtos"),
    })
    return laid_out(cells, digit != 6, digit != 8), sheets(rows, key)


def line_center(line: int) -> int:
    return FIRST_LINE + LEADING * line + TALL // 2
