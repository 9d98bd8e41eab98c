"""Near-duplicate embeddings by lattice hashing.

Each of several tables projects a unit vector at random to eight dimensions and decodes it to the nearest point of the
E8 lattice. A vector is filed under its own cell and also looks into the nearest neighbouring cells; vectors that meet
in a cell of one label are compared by cosine in double precision. Equal vectors are one node with a multiplicity, so a
vector that is repeated thousands of times is compared once.

Rows with a null id keep no links and are their own component (null). Vectors that are null, empty, zero, or hold null
or non-finite components, and vectors with a null label, link with nothing. Rows that repeat an id count as one vector
each for n_links. Vectors of other lengths than most are compared with vectors of their own length only. Labels may be
of any type and are compared by value, as text that is equal only for equal values (see label_text). Only the named
columns are read, so extra columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, mix, written

#: Tables, neighbouring cells probed in each, and the projection's scale: measured for recall at a cosine of 0.93.
TABLES, PROBES, SCALE = 8, 12, 0.9
COSINE = 0.93


@lru_cache(1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of size 1, or all of size 1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd move the worst place the other way."""
    x = np.rint(y)
    odd = np.flatnonzero(x.sum(axis=1) % 2 != 0)
    if len(odd):
        off = y[odd] - x[odd]
        worst = np.abs(off).argmax(axis=1)
        side = off[np.arange(len(odd)), worst]
        x[odd, worst] += np.where(side >= 0, 1.0, -1.0)
    return x


def nearest_e8(y: np.ndarray) -> np.ndarray:
    whole, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def cell_keys(points: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
    h = mix(label.astype(np.int64).view(np.uint64) * np.uint64(64) + np.uint64(table + 1))
    for k in range(points.shape[-1]):
        h = mix(h ^ (np.rint(points[..., k] * 2).astype(np.int64)).view(np.uint64))
    return h.view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (rows x tables) and neighbouring cells (rows x tables x probes)."""
    own, near = [], []
    for t in range(tables):
        project = np.random.default_rng((unit.shape[1], t)).standard_normal((unit.shape[1], 8)) * scale
        y = unit @ project
        x = nearest_e8(y)
        own.append(cell_keys(x, t, label))
        gain = (y - x) @ neighbours().T
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
        near.append(np.stack([cell_keys(x + neighbours()[best[:, p]], t, label) for p in range(probes)], axis=1))
    return np.stack(own, axis=1), np.stack(near, axis=1)


def label_text(df: DataFrame, col: str) -> Column:
    """The label as text, equal for equal labels only: -0.0 is 0.0 and NaN is NaN, as in Spark's own comparisons."""
    kind, c = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(kind, T.FloatType | T.DoubleType):
        c = c + F.lit(0.0).cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return c.cast("string")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (vec_id, node) of all vectors with a defined direction, and links (a, b, cosine) of nodes, each
    pair once. A node is the smallest id of an equal vector of the same label."""
    v = F.col("v")
    # Single precision travels as such, at half the size; cosines are taken in double precision.
    given = df.schema[vector_col].dataType.simpleString()
    kept = given if given in ("array<float>", "array<double>") else "array<double>"
    sound = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are the same direction: adding 0.0 makes them one bit pattern.
    rows = (
        df.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col).cast(kept), lambda x: x + F.lit(0.0).cast(kept[6:-1])).alias("v"), label_text(df, label_col).alias("label"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
        .withColumn("same", F.md5(F.concat_ws(",", v.cast("array<string>"), F.md5(F.col("label").cast("binary"))).cast("binary")))
    )
    nodes = rows.groupBy("same").agg(F.min("vec_id").alias("node"))
    members = written(rows.join(nodes, "same").select("vec_id", "node", "label", F.when(F.col("vec_id") == F.col("node"), v).alias("v")), "vectors")
    # max: an id that repeats with other vectors still gives one vector for each node
    unique = members.where("v is not null").groupBy("node", "label").agg(F.max("v").alias("v"))
    unique = written(unique, "nodes")

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(2)
            sizes = np.diff(np.asarray(values.offsets))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = values.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, size)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                label, node = b.column(1).to_numpy()[at], b.column(0).take(pa.array(at))
                own, near = cells(x, label * 4099 + size, tables, probes, scale)
                for t in range(tables):
                    both = np.concatenate([own[:, t : t + 1], near[:, t]], axis=1)
                    k = np.repeat(np.arange(len(at)), probes + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(both.ravel()), node.take(pa.array(k)), pa.array(np.tile(np.arange(probes + 1) == 0, len(at)))], ["cell", "node", "own"])

    node_type = unique.schema["node"].dataType.simpleString()
    looked = written(unique.select("node", F.xxhash64("label").alias("label"), "v").mapInArrow(filed, f"cell long, node {node_type}, own boolean"), "cells")
    homes = looked.where("own").select("cell", F.col("node").alias("a"))
    pairs = (
        looked.join(homes, "cell").where("node <> a")
        .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, -2.0)
            left, right = b.column(2), b.column(3)
            n, m = np.diff(np.asarray(left.offsets)), np.diff(np.asarray(right.offsets))
            for size in np.unique(n[n == m]):
                at = np.flatnonzero((n == size) & (m == size))
                x, y = (c.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, size) for c in (left, right))
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                out[at] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["a", "b", "cosine"])

    va, vb = (unique.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"), F.col("v").alias(f"v{c}")) for c in "ab")
    links = (
        pairs.join(va, "a").join(vb, "b").where("la = lb").select("a", "b", "va", "vb")
        .mapInArrow(compared, f"a {node_type}, b {node_type}, cosine double").where(F.col("cosine") >= cosine)
    )
    return members.select("vec_id", "node"), written(links, "links")


def linked(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **params) -> DataFrame:
    """One row per row of df: the id, n_links (other vectors linked directly), component_id (the smallest id reachable)
    and kept (whether that is its own). See near_vectors for the parameters."""
    members, links = near_vectors(df, id_col, vector_col, label_col, **params)
    copies = members.groupBy("node").agg(F.count("*").alias("copies"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    reached = components(links)
    node = copies.join(around, "node", "left").join(reached, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c"))
    # an id that repeats with several vectors has the links of all of them
    found = members.distinct().join(node, "node").groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    return df.select(F.col(id_col).alias("vec_id")).join(found, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
