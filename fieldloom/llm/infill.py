"""Fill-in-middle transformation of documents, with cuts found by a sparse checkpoint index.

A text is cut into lines, its units. While the lines are counted, the byte and code-point offsets after every STEP lines
are recorded. A cut after some number of lines is then found by binary search among these checkpoints and a short rescan
from there, so the place of each line is never kept. Prefix, middle and suffix come out in the order of the form: psm is
`<P>` prefix `<S>` suffix `<M>` middle, spm is `<S>` suffix `<P>` prefix `<M>` middle, and plain is the text itself.

Cuts and form depend on a hash of the seed and the id alone, so a lost task gives the same rows again. Texts that are
null, empty, or hold one of the marks are plain, so a mark stands nowhere else in an output and the text can be rebuilt.
A null id hashes as an empty one. Repeated rows give equal rows; extra columns are kept, and result columns replace
columns of the same name; an empty table gives an empty table. Texts are taken in slices of about a megabyte, a longer text
alone, so memory is bounded by the longest text; its counting takes SEGMENT bytes at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT, slices, unused

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Lines between checkpoints.
STEP = 64
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


class Checkpoints:
    """The number of lines of a text, and where they end. `units`, `places` and `points` hold, for each checkpoint, how many
    lines, bytes and code points stand before it."""

    def __init__(self, data: bytes, step: int = STEP):
        self.data, self.bytes = data, np.frombuffer(data, np.uint8)
        self.units, self.places, self.points = [0], [0], [0]
        self.n = points = 0
        for at in range(0, len(data), SEGMENT):
            part = self.bytes[at : at + SEGMENT]
            ends = np.flatnonzero(part == 10) + 1
            marked = ends[(-self.n - 1) % step :: step]
            if len(marked):
                first = self.n + (-self.n - 1) % step + 1
                self.units += range(first, first + step * len(marked), step)
                self.places += (at + marked).tolist()
                begun = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                self.points += (points + begun[marked]).tolist()
                points += int(begun[-1])
            else:
                points += int(np.count_nonzero((part & 0xC0) != 0x80))
            self.n += len(ends)
        self.n += bool(data) and data[-1] != 10
        self.total = points

    def after(self, units: int) -> tuple[int, int]:
        """The byte and code-point offsets at which so many lines have ended."""
        if units >= self.n:
            return len(self.data), self.total
        k = bisect_right(self.units, units) - 1
        place = self.places[k]
        for _ in range(units - self.units[k]):
            place = self.data.index(b"\n", place) + 1
        passed = self.bytes[self.places[k] : place]
        return place, self.points[k] + int(np.count_nonzero((passed & 0xC0) != 0x80))


def transformed(data: bytes, h: list[int], rate: int, spm: int, step: int = STEP) -> tuple[int, str, int | None, int | None, bytes]:
    """The lines of a text, its form, the code points of its prefix and middle, and what is put out for it."""
    index = Checkpoints(data, step)
    if not data or h[2] % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, data
    a, b = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (first, chars), (second, more) = index.after(a), index.after(b)
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    if h[3] % 100 < spm:
        form, out = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, out = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return index.n, form, chars, more - chars, out


def hashes(seed: int, id_col: Column) -> Column:
    """The first four 8-digit groups of the sha256 of `seed:id` as numbers."""
    digits = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(digits, 8 * k + 1, F.lit(8)), 16, 10).cast("long"))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and output. Of a hundred texts about `rate` are transformed, and of a
    hundred of these about `spm` have the suffix first."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names, types = zip(*((f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in RESULT.split(", ")))
        for text, numbers in batches:
            parts = [pa.array([], pa.struct(list(zip(names, types))))]
            for first, size in slices(text):
                rows = [transformed((x.as_py() or "").encode(), h, rate, spm) for x, h in zip(text.slice(first, size), numbers.slice(first, size).to_pylist())]
                cols = [*zip(*rows)]
                cols[4] = pa.array(cols[4], pa.binary()).cast(pa.string())
                parts.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], list(names)))
            yield pa.concat_arrays(parts)

    said = unused(df, "_said")
    judged = df.withColumn(said, F.arrow_udf(cut, RESULT)(F.col(f"`{text_col}`"), hashes(seed, F.col(f"`{id_col}`"))))
    results = [f.split()[0] for f in RESULT.split(", ")]
    return judged.select(*(F.col(f"`{c}`") for c in df.columns if c not in results), *(F.col(f"{said}.{c}").alias(c) for c in results))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(F.substring(output, 4, F.length(output)), "<[PSM]>", -1)
    ordered = F.when(form == "spm", F.concat(parts[1], parts[2], parts[0])).otherwise(F.concat(parts[0], parts[2], parts[1]))
    return F.when(form == "plain", output).otherwise(ordered)
