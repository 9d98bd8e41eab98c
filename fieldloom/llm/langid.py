"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded, convolved with filters of several widths, pooled by maximum over windows of fixed length, and
classified by a softmax layer. A text is cut into windows without overlap, all of them are classified, and their mean
log-probabilities decide. A convolution over embedded bytes is a sum of table look-ups, so two bytes at a time are
looked up in tables made from the trained weights.

The network learns from a bounded sample: about SAMPLE rows of each of the LANGUAGES most frequent languages, picked by
a hash of the id at a rate per language, and WINDOWS windows of each. Rows with a null id, text or language are never
learned from. Texts that are null or have no letter are `und` with score 1; without any labelled row all texts are
`und` with score 0. Repeated rows get equal results; extra columns are kept, and result columns replace columns of the
same name. Languages beyond the LANGUAGES most frequent are never predicted. Texts are taken in slices of about a
megabyte, a longer text alone, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices, unused

WINDOW, WIDTHS, FILTERS, EMBEDDED = 256, (2, 3, 4), 8, 8
SAMPLE, LANGUAGES, WINDOWS = 1000, 256, 3
EPOCHS, BATCH, RATE = 6, 64, 0.01


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 0 modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(windows: np.ndarray, target: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Weights of the network, trained by Adam on rows of bytes and their class numbers; classes weigh alike."""
    r = np.random.default_rng(seed)
    p = {"embed": r.normal(0, 0.3, (256, EMBEDDED)), "dense": r.normal(0, 0.3, (len(WIDTHS) * FILTERS, classes)), "bias": np.zeros(classes)}
    for w in WIDTHS:
        p[f"conv{w}"], p[f"shift{w}"] = r.normal(0, (w * EMBEDDED) ** -0.5, (w, EMBEDDED, FILTERS)), np.zeros(FILTERS)
    weight = len(target) / np.maximum(1, np.bincount(target, minlength=classes)) / classes
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = r.permutation(len(target))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]], target[order[at : at + BATCH]]
            rows, pooled, places = np.arange(len(x)), [], []
            for w in WIDTHS:
                n = x.shape[1] - w + 1
                out = sum((p["embed"] @ p[f"conv{w}"][o])[x[:, o : o + n]] for o in range(w)) + p[f"shift{w}"]
                places.append(out.argmax(axis=1))
                pooled.append(np.maximum(out.max(axis=1), 0))
            h = np.concatenate(pooled, axis=1)
            z = h @ p["dense"] + p["bias"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[rows, y] -= 1
            q *= weight[y][:, None] / len(x)
            g = {"dense": h.T @ q, "bias": q.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            back = (q @ p["dense"].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                b = back[:, k * FILTERS : (k + 1) * FILTERS]
                g[f"shift{w}"], g[f"conv{w}"] = b.sum(axis=0), np.zeros_like(p[f"conv{w}"])
                for o in range(w):
                    seen = x[rows[:, None], places[k] + o]
                    g[f"conv{w}"][o] = np.einsum("nfe,nf->ef", p["embed"][seen], b)
                    np.add.at(g["embed"], seen.ravel(), (b[:, :, None] * p[f"conv{w}"][o].T[None]).reshape(-1, EMBEDDED))
            step += 1
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def tables(p: dict) -> dict:
    """For each width, tables of two neighbouring bytes (and of one, where the width is odd) that sum to the convolution."""
    out = {}
    for w in WIDTHS:
        one = [(p["embed"] @ p[f"conv{w}"][o]).astype(np.float32) for o in range(w)]
        pairs = [(one[o][:, None, :] + one[o + 1][None, :, :]).reshape(65536, FILTERS) for o in range(0, w - 1, 2)]
        out[w] = pairs, one[-1] if w % 2 else None
    return out


def log_probabilities(windows: np.ndarray, p: dict, look: dict) -> np.ndarray:
    two = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
    pooled = []
    for w in WIDTHS:
        n = windows.shape[1] - w + 1
        pairs, last = look[w]
        out = pairs[0].take(two[:, :n], axis=0)
        for k, t in enumerate(pairs[1:], 1):
            out += t.take(two[:, 2 * k : 2 * k + n], axis=0)
        if last is not None:
            out += last.take(windows[:, w - 1 : w - 1 + n], axis=0)
        pooled.append(np.maximum(out.max(axis=1) + p[f"shift{w}"], 0))
    z = np.concatenate(pooled, axis=1) @ p["dense"] + p["bias"]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut(texts: pa.Array, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows, the last of each filled up with zero bytes, and the row of each window."""
    data, offsets = bytes_of(texts)
    counts = -(-np.diff(offsets) // size)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(first[-1]) * size, np.uint8)
    for at, begin, end in zip((first[:-1] * size).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        out[at : at + end - begin] = data[begin:end]
    return out.reshape(-1, size), np.repeat(np.arange(len(counts)), counts)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[list[str], dict]:
    """The languages, sorted, and the weights, from rows that are not held out."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held"))
    rows = rows.where("not held and lang is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return [], {}
    # A rate per language, by a hash of id and text: a bounded sample without a sort or a hot group. Rows that repeat an id
    # and a text are one to it, and give the same windows, which count once.
    rate = F.create_map(*[F.lit(x) for c in counts for x in (c["lang"], min(1.0, sample / c["texts"]))])
    chosen = rows.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < rate[F.col("lang")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(1)):
                c = b.slice(*part)
                got, row = cut(c.column(1))
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                total = np.bincount(row, minlength=c.num_rows)[row]
                step = np.maximum(1, -(-total // WINDOWS))
                keep = np.flatnonzero((rank % step == 0) & ((rank < total - 1) | (total == 1)))
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(row[keep])), c.column(2).take(pa.array(row[keep])), pa.array([x.tobytes() for x in got[keep]], pa.binary())], ["id", "lang", "bytes"])

    got = sorted(map(tuple, chosen.select("id", "text", "lang").mapInArrow(windows, "id string, lang string, bytes binary").distinct().collect()))
    names = sorted({x[1] for x in got})
    if not names:
        return [], {}
    x = np.frombuffer(b"".join(x[2] for x in got), np.uint8).reshape(-1, WINDOW)
    return names, fit(x, np.array([names.index(g[1]) for g in got]), len(names), epochs)


def predict(df: DataFrame, names: list[str], weights: dict, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score of each whole text."""

    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        letter, look = regex.compile(r"\p{L}").search, tables(weights) if names else {}
        for text in batches:
            pred, score = [], []
            for part in slices(text):
                c = text.slice(*part)
                said = np.array([x.is_valid and letter(x.as_py()) is not None for x in c])
                total = np.zeros((len(c), max(1, len(names))))
                counts = np.ones(len(c))
                if names and said.any():
                    got, row = cut(c)
                    counts = np.maximum(1, np.bincount(row, minlength=len(c)))
                    for k in range(0, len(got), 512):
                        np.add.at(total, row[k : k + 512], log_probabilities(got[k : k + 512], weights, look))
                mean = total / counts[:, None]
                q = np.exp(mean - mean.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                best = q.argmax(axis=1)
                pred += [names[k] if s and names else "und" for k, s in zip(best.tolist(), said.tolist())]
                score += [float(v) if s and names else float(not s) for v, s in zip(q.max(axis=1), said.tolist())]
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    # Only the text goes to Python; the other columns wait in the JVM.
    judge = F.arrow_udf(classify, "lang_pred string, score double")
    said = unused(df, "_said")
    judged = df.withColumn(said, judge(F.col(f"`{text_col}`")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    return judged.select(*kept, f"{said}.lang_pred", f"{said}.score")
