"""Chroma audio fingerprints of a media column, and search by them.

A WAV recording becomes frames of twelve pitch classes. Filters, sums over rectangles of the frames read from an
integral image, are compared and packed, two bits each, into one integer per place. Recordings that share integers vote
for the offset between them; offsets with at least half as many votes as the best are checked by the share of differing
bits over the whole overlap, and the one that differs least counts.

A pair needs VOTES votes, or half as many as the shorter recording has integers, if that is less, but one at least. So a
recording of any length is searched and found; what shares no integer with it at the right offset is not, whatever its
bit errors. A recording of one integer (up to 19 words as made here) is found only where that integer stands unchanged.

Equal recordings are one class, compared once: matches are pairs of classes, each named by its smallest id, beside the
class of every recording. So copies are found, but never listed as pairs. Null, empty, silent or unreadable recordings,
among them those whose header names no rate or no channel, have no fingerprint, no class and no match; 16-bit samples are
read. Every recording is brought to RATE first, so one tune at two rates agrees. Rows that repeat an id are recordings of
their own. Only the named columns are used, so extra columns cannot clash; an empty table gives empty tables.

Integers that are common are dealt over tasks, so none makes a hot group. Memory is bounded by BATCH recordings and by the
longest one.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, frequent, looked_up, written

RATE, FRAME, HOP, SPAN = 4000, 1024, 256, 16
#: Recordings sent to Python at once.
BATCH = 256
#: Filters: (kind, first pitch class, pitch classes, first frame, frames) within a span of 16 frames.
FILTERS = [(k % 4, (5 * k) % 12, 1 + k % 4, k % 8, 4 + 2 * (k % 5)) for k in range(16)]
#: Votes a pair of long recordings needs at its best offset, and the greatest share of differing bits.
VOTES, BIT_ERRORS = 4, 0.2


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12: energy by pitch class, each frame scaled to length 1 unless silent."""
    if len(samples) < FRAME:
        samples = np.pad(samples, (0, FRAME - len(samples)))
    n = 1 + (len(samples) - FRAME) // HOP
    pitch = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (pitch > 60) & (pitch < rate / 2)
    to = np.zeros((len(pitch), 12))
    to[np.flatnonzero(heard), np.rint(12 * np.log2(pitch[heard] / 440)).astype(int) % 12] = 1
    out, fade = np.empty((n, 12)), np.hanning(FRAME)
    for at in range(0, n, 256):
        k = np.arange(at, min(n, at + 256))
        frames = samples[k[:, None] * HOP + np.arange(FRAME)] * fade
        out[k] = np.abs(np.fft.rfft(frames)) ** 2 @ to
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.where(size > 1e-9, size, 1)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One int32 per frame at which a span begins; short recordings are filled up with silence."""
    if not len(samples) or not np.any(samples):
        return np.zeros(0, np.int32)
    c = chroma(samples.astype(np.float64), rate)
    if len(c) < SPAN:
        c = np.pad(c, ((0, SPAN - len(c)), (0, 0)))
    area = np.zeros((len(c) + 1, 25))
    area[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([c, c], axis=1), axis=0), axis=1)  # pitch classes go round
    n = len(c) - SPAN + 1
    t = np.arange(n)
    box = lambda a, b, p, q: area[t + b, q] - area[t + a, q] - area[t + b, p] + area[t + a, p]
    out = np.zeros(n, np.uint32)
    for k, (kind, low, high, first, long) in enumerate(FILTERS):
        a, b, p, q = first, min(SPAN, first + long), low, low + 2 * high
        mid, half = (a + b) // 2, low + high
        if kind == 0:
            v = box(a, mid, p, q) - box(mid, b, p, q)
        elif kind == 1:
            v = box(a, b, p, half) - box(a, b, half, q)
        elif kind == 2:
            v = box(a, mid, p, half) + box(mid, b, half, q) - box(mid, b, p, half) - box(a, mid, half, q)
        else:
            third = (b - a) // 3
            v = box(a, b, p, q) - 2 * box(a + third, b - third, p, q)
        level = (v > 0).astype(np.uint32) * 2 + (np.abs(v) > 0.5).astype(np.uint32)
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * k)
    return out.view(np.int32)


def samples_of(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a 16-bit WAV file; nothing for one that cannot be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0, np.int16), RATE
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2")
            return raw[: len(raw) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError, ValueError, ZeroDivisionError, struct.error):
        return np.zeros(0, np.int16), RATE


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """The samples at RATE: between two of them on a line, and each the mean around it where there are more than needed."""
    if rate == RATE or not len(samples):
        return samples
    if rate <= 0:
        return np.zeros(0)
    x = samples.astype(np.float64)
    if (wide := rate // RATE) > 1:
        total = np.concatenate([[0.0], np.cumsum(x)])
        at = np.arange(len(x))
        low, high = np.maximum(0, at - wide // 2), np.minimum(len(x), at - wide // 2 + wide)
        x = (total[high] - total[low]) / (high - low)
    n = max(1, int(len(x) * RATE / rate))
    return np.interp(np.arange(n) * (rate / RATE), np.arange(len(x)), x)


def fingerprints(df: DataFrame, id_cols: list[str], audio_col: str = "audio") -> DataFrame:
    """Rows (id columns, sha, prints array<int>) of the recordings that have a fingerprint."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(resampled(*samples_of(x.as_py()))) for x in b.column(len(id_cols) + 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.list_(pa.int32()))], [*id_cols, "sha", "prints"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)
    return df.select(*id_cols, F.sha2(audio_col, 256).alias("sha"), audio_col).mapInArrow(each, f"{kinds}, sha string, prints array<int>").where("size(prints) > 0")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends BATCH rows to Python at once: recordings are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def search(df: DataFrame, queries: Column, id_cols: list[str], audio_col: str = "audio", votes: int = VOTES, bit_errors: float = BIT_ERRORS) -> tuple[DataFrame, DataFrame]:
    """(members, matches). Members: for each recording with a fingerprint the id columns, class (the smallest id of an
    equal recording) and copies (equal recordings besides it). Matches: for each class with a recording that `queries`
    selects, each other class that aligns with it: class, match, offset (frames of the query before the match begins),
    overlap (frames compared) and bit_errors."""
    rec = F.struct(*id_cols)
    with small_batches(df.sparkSession):
        prints = written(fingerprints(df, id_cols, audio_col).withColumn("asked", F.coalesce(queries, F.lit(False))), "prints")
    nodes = written(prints.groupBy("sha").agg(F.min(rec).alias("node"), F.count("*").alias("size"), F.max("asked").alias("asked")), "classes")
    unique = prints.select("sha", rec.alias("node"), "prints").join(nodes, ["sha", "node"]).dropDuplicates(["sha"])
    unique = written(unique, "recordings")
    index = unique.select("sha", F.size("prints").alias("n"), F.posexplode("prints").alias("at", "key"))
    # Rows of a common integer are dealt over shares, each with all queries that have it.
    sizes = index.groupBy("key").agg(F.count("*").alias("size"))
    hot = frequent(sizes, unique.agg(F.sum(F.size("prints"))).first()[0] or 0)
    asked = index.join(unique.where("asked").select("sha"), "sha", "left_semi").select(F.col("sha").alias("q"), F.col("n").alias("m"), F.col("at").alias("qat"), "key")
    hits = dealt_join(index, asked, ["key"], hot).where("q <> sha").groupBy("q", "sha", "m", "n", (F.col("qat") - F.col("at")).alias("offset")).count()
    shorter, overlap = F.least("m", "n"), lambda o: F.least(F.col("m"), F.col("n") + o) - F.greatest(o, F.lit(0))
    enough = (F.col("count") >= F.least(F.lit(votes), F.greatest(F.lit(1), F.floor(shorter / 2)))) & (overlap(F.col("offset")) >= F.least(F.lit(votes), shorter))
    voted = hits.where(enough).groupBy("q", "sha", "m", "n").agg(F.collect_list(F.struct("count", "offset")).alias("o"), F.max("count").alias("most"))
    best = voted.select("q", "sha", "m", "n", F.expr("transform(filter(o, x -> 2 * x.count >= most), x -> x.offset)").alias("offsets"))
    left = unique.select(F.col("sha").alias("q"), F.col("node").alias("class"), F.col("prints").alias("x"))
    both = best.join(left, "q").join(unique.select("sha", F.col("node").alias("match"), F.col("prints").alias("y")), "sha")

    def compared(o: Column) -> Column:
        begin = F.greatest(o, F.lit(0))
        differ = F.zip_with(F.slice("x", begin + 1, overlap(o)), F.slice("y", begin - o + 1, overlap(o)), lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))))
        return F.struct((F.aggregate(differ, F.lit(0), lambda a, b: a + b) / (32.0 * overlap(o))).alias("bit_errors"), o.alias("offset"), overlap(o).alias("overlap"))

    found = both.select("class", "match", F.array_min(F.transform("offsets", compared)).alias("b")).select("class", "match", "b.*").where(F.col("bit_errors") <= bit_errors)
    sizes = nodes.select("sha", "size", F.struct(F.col("node").alias("class"), (F.col("size") - 1).alias("copies")).alias("c"))
    members = looked_up(prints.select(*id_cols, "sha"), sizes, "sha").select(*id_cols, "c.class", "c.copies")
    return members, found.select("class", "match", "offset", "overlap", "bit_errors")


def sonified(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Rows (id columns, audio): a WAV recording of each text, one note per word by a hash of the word. It stands for a
    media table where there is none; null and wordless texts are silent."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        t = np.arange(HOP) / RATE
        notes = [(8000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) * np.hanning(HOP)).astype("<i2") for k in range(24)]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for x in part.column(len(id_cols)):
                    words = (x.as_py() or "").split()
                    with wave.open(held := io.BytesIO(), "wb") as w:
                        w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
                        w.writeframes(b"".join(notes[zlib.crc32(y.encode()) % 24].tobytes() for y in words))
                    out.append(held.getvalue())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], [*id_cols, "audio"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)
    return df.select(*id_cols, text_col).mapInArrow(play, f"{kinds}, audio binary")
