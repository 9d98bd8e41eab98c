"""Quality scores of documents by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a vector of counts of its hashed terms: words, runs of three bytes, runs of four character classes (capitals,
letters, digits, marks, space), and how often words came before. Counts are damped, weighted by inverse document frequency over
all texts, and projected on the leading singular directions of the labelled texts. The labelled vectors, at most SAMPLE of
them whatever the input, are broadcast; the cosine of each document with each of them is computed exactly, in blocks,
and the NEIGHBOURS nearest vote with a power of their similarity.

Labels are learned from rows that are not held out: the SAMPLE rows with the smallest hashes of their ids, of those whose
label is 0 or 1. A label whose id has no text counts for nothing; an id with several labels or texts is as many labelled
texts. Null, empty and blank texts have no terms, and like all texts without a similar neighbour they get the share of ones
among the labels as score, or 0.5 where nothing is labelled. Repeated rows get equal scores; extra columns are kept, and
result columns replace columns of the same name; an empty table gives an empty table. Texts are taken in slices of about a
megabyte, a longer text alone, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bytes_of, slices, unused, words_of

#: Labelled texts at most, dimensions of their vectors, neighbours that vote, and the power of their similarity.
SAMPLE, DIMENSIONS, NEIGHBOURS, POWER = 4000, 32, 15, 4
#: Places of hashed words, byte runs (twelve bits), class runs, and numbers of earlier occurrences.
WORDS, RUNS, CLASSES, AGAIN = 2048, 4096, 1296, 16
TERMS = WORDS + RUNS + CLASSES + AGAIN
#: Rows in a slice: a slice is a table of counts with TERMS columns.
ROWS = 128


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 1 modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _classes() -> np.ndarray:
    """The class of each byte: marks, capitals, small letters, digits, white space, and bytes of other characters."""
    out = np.zeros(256, np.int32)
    out[65:91], out[97:123], out[48:58], out[9:14], out[32], out[128:] = 1, 2, 3, 4, 4, 5
    return out


CLASS_OF = _classes()


def counts(texts: pa.Array) -> np.ndarray:
    """A row for each text with the number of times that each of its terms stands in it."""
    data, offsets = bytes_of(texts)
    rows = len(offsets) - 1
    words, ends = words_of(texts)
    out = np.zeros((rows, TERMS), np.float32)

    def add(first: int, size: int, row: np.ndarray, term: np.ndarray) -> None:
        out[:, first : first + size] = np.bincount(row * size + term, minlength=rows * size).reshape(rows, size)

    row = np.repeat(np.arange(rows), np.diff(ends))
    add(0, WORDS, row, (words % U64(WORDS)).astype(np.int64))
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    b, c = data.astype(np.uint32), CLASS_OF[data]
    inside = row[2:] == row[:-2]
    run = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1) >> 20).astype(np.int32)
    add(WORDS, RUNS, row[2:][inside], run[inside])
    inside = row[3:] == row[:-3]
    run = ((c[:-3] * 6 + c[1:-2]) * 6 + c[2:-1]) * 6 + c[3:]
    add(WORDS + RUNS, CLASSES, row[3:][inside], run[inside])
    # Of c equal words of a row, those from the 2**k-th to the one before the 2**(k+1)-th stand in place k.
    both = np.sort(np.repeat(np.arange(rows), np.diff(ends)).astype(U64) << U64(48) | words >> U64(16))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    times, row = np.diff(np.concatenate([first, [len(both)]])), (both[first] >> U64(48)).astype(np.int64)
    for k in range(AGAIN):
        there = np.clip(times - ((1 << k) - 1), 0, 1 << k)
        if not there.any():
            break
        out[:, WORDS + RUNS + CLASSES + k] = np.bincount(row, there, rows)
    return out


def vectors(counted: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Damped and weighted counts, each kind of term of length one, or zero."""
    x = np.sqrt(counted)
    at = 0
    for size in (WORDS, RUNS, CLASSES, AGAIN):
        part = x[:, at : at + size]
        part *= weights[at : at + size]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
        at += size
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def directions(x: np.ndarray, dimensions: int, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a random start."""
    k = min(dimensions, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).normal(size=(x.shape[0], min(k + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    small = (x @ q).astype(np.float64)
    values, turn = np.linalg.eigh(small.T @ small)
    return (q @ turn[:, ::-1][:, :k].astype(np.float32)).astype(np.float32)


def document_frequencies(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each term stands, and the number of texts: a table of TERMS rows at most comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros(TERMS, np.int64), 0
        for b in batches:
            for part in slices(b.column(0), rows=ROWS):
                seen = counts(b.column(0).slice(*part)) > 0
                found += seen.sum(axis=0)
                texts += int(seen.any(axis=1).sum())
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *term.tolist()], pa.int32()), pa.array([texts, *found[term].tolist()], pa.int64())], ["term", "n"])

    got = df.select(text_col).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, texts = np.zeros(TERMS, np.int64), 0
    for x in got:
        if x["term"] < 0:
            texts = x["n"]
        else:
            out[x["term"]] = x["n"]
    return out, texts


def labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts and labels of at most `sample` labelled texts that are not held out."""
    # Two bounded steps: the chosen labels are few enough to be broadcast, and of texts that share an id as many are kept.
    rows = labels.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").distinct()
    chosen = rows.withColumn("h", F.xxhash64("id", "label")).orderBy("h", "id", "label").limit(sample)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").select("h", "label", "text", F.md5(F.col("text").cast("binary")).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(2), rows=ROWS):
                c = b.slice(*part)
                got = counts(c.column(2))
                full = np.flatnonzero(got.any(axis=1))
                places = [np.flatnonzero(got[k]) for k in full]
                terms, numbers = pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())), pa.array([got[k][p] for k, p in zip(full, places)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(c.column(k).take(pa.array(full)) for k in (0, 1, 3)), terms, numbers], ["h", "label", "t", "terms", "numbers"])

    counted = joined.mapInArrow(count, "h long, label int, t string, terms array<int>, numbers array<float>").dropDuplicates(["h", "t"])
    got = counted.orderBy("h", "t").limit(sample).toArrow()
    x = np.zeros((got.num_rows, TERMS), np.float32)
    for k, (terms, numbers) in enumerate(zip(got["terms"], got["numbers"])):
        x[k, terms.values.to_numpy()] = numbers.values.to_numpy()
    return x, got["label"].to_numpy().astype(np.float64)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> dict:
    """Term weights, directions, labelled vectors and labels."""
    counted, target = labelled(df, labels, id_col, text_col, label_col, sample)
    if not len(target):
        return {"target": target}
    found, texts = document_frequencies(df, text_col)
    weights = np.log((texts + 1) / (found + 1)).astype(np.float32) + np.float32(1)
    x = vectors(counted, weights)
    turn = directions(x, dimensions)
    return {"target": target, "weights": weights, "directions": turn, "vectors": unit(x @ turn)}


def votes(x: np.ndarray, model: dict, neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
    """The weighted share of ones among the labelled vectors nearest to each row; without any, that of all labels."""
    target = model["target"]
    cosine = x @ model["vectors"].T
    k = min(neighbours, len(target))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** power
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * target[near]).sum(axis=1) / np.where(total > 0, total, 1), target.mean())


def scored(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """df with the score of each whole text and what it predicts."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE and TERMS

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for text in batches:
            score = [np.zeros(0)]
            for part in slices(text, rows=ROWS):
                if len(model["target"]):
                    x = vectors(counts(text.slice(*part)), model["weights"])
                    score.append(votes(unit(x @ model["directions"]), model))
                else:
                    score.append(np.full(part[1], 0.5))
            yield pa.array(np.clip(np.concatenate(score), 0, 1), pa.float64())

    # Only the text goes to Python; the other columns wait in the JVM.
    said = unused(df, "_said")
    judged = df.withColumn(said, F.arrow_udf(judge, "double")(F.col(f"`{text_col}`")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("score", "predicted")]
    return judged.select(*kept, F.col(said).alias("score"), (F.col(said) >= 0.5).cast("int").alias("predicted"))
