"""What the operators share: tables in the shared folder, blocks of rows, word hashes and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import stored as written

U64 = np.uint64
#: Odd multipliers of the polynomial hashes over bytes (two, for hashes that must not collide together) and over words.
BYTE_BASE, OTHER_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Bytes or words hashed at once: bounds the memory of a task whatever the length of its texts, and the tables of powers
#: that a Python worker keeps when it is idle.
SEGMENT = 1 << 18


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """The name, or the first longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is frequent if it stands on more than one row in so many; so there are fewer than so many frequent keys.
FREQUENT = 1000
#: Keys with so few rows are never frequent.
FEW = 1000


def frequent(sizes: DataFrame, total: int) -> list[Row]:
    """Of rows (key columns, size): the keys that are frequent among `total` rows, with the number of shares over which
    their rows are dealt. Fewer than FREQUENT, whatever the input."""
    most = max(FEW, total // FREQUENT)
    return sizes.where(F.col("size") > most).withColumn("_shares", F.ceil(F.col("size") / most).cast("int")).drop("size").collect() if total > FEW else []


def small(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A few rows of the driver as a table. They go as Arrow, which the JVM reads; a list of rows would be passed through Python
    workers of the executors, and these stay there."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table({f.name: pa.array(c) for f, c in zip(schema, columns)}), schema)


def dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: list[Row], how: str = "inner") -> DataFrame:
    """The join (inner or left) of rows with a table that has one row per key. The rows of a frequent key are dealt over
    its shares, and the table has a copy of its row for each; only the frequent keys are broadcast."""
    if not hot:
        return rows.join(table, keys, how)
    shares = F.broadcast(small(rows.sparkSession, hot, table.select(*keys, F.lit(0).alias("_shares")).schema))
    others = [c for c in rows.columns if c not in keys]
    dealt = rows.join(shares, keys, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(*others), F.col("_shares")), F.lit(0)).cast("int"))
    copies = table.join(shares, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
    return dealt.drop("_shares").join(copies.drop("_shares"), [*keys, "_share"], how).drop("_share")


def looked_up(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """dealt_join with a stored table that has in `size` the number of rows with each key."""
    keys = [key] if isinstance(key, str) else key
    hot = frequent(table.select(*keys, "size"), table.agg(F.sum("size")).first()[0] or 0)
    return dealt_join(rows, table.drop("size"), keys, hot, how)


def spread(rows: DataFrame, table: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """dealt_join of stored rows, whose keys are counted here; counts are combined before the shuffle."""
    hot = frequent(rows.groupBy(key).agg(F.count("*").alias("size")), rows.count() if total is None else total)
    return dealt_join(rows, table, [key], hot)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that all bits depend on all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n + 1:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[base]


def bytes_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and each row's offsets in them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, most: int = 1 << 20, rows: int = 512) -> Iterator[tuple[int, int]]:
    """Runs (start, length) of rows with about `most` bytes of text in each, one row at least and `rows` at most."""
    ends = np.cumsum(np.diff(bytes_of(texts)[1]))
    at = before = 0
    while at < len(ends):
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield at, stop - at
        at, before = stop, int(ends[stop - 1])


def words_of(texts: pa.Array | pa.ChunkedArray, base: int = BYTE_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all rows in order: their 64-bit hashes, and each row's offsets among them."""
    data, offsets = bytes_of(texts)
    n = len(data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    inner = ~gap
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inner[edge]
    ends[edge - 1] = inner[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(stops, starts[first] + SEGMENT, "right")))
        low, high = starts[first], stops[last - 1]
        up, down = powers(base, min(int(high - low), SEGMENT))
        if high - low > SEGMENT:  # one very long word: hash it piece by piece
            h = U64(0)
            for at in range(low, high, SEGMENT):
                piece = data[at : min(high, at + SEGMENT)].astype(U64) + U64(1)
                h = mix(np.array([h + (piece * up[: len(piece)]).sum(dtype=U64)], U64))[0]
            hashes[first:last] = h
        else:
            total = np.zeros(high - low + 1, U64)
            np.cumsum((data[low:high].astype(U64) + U64(1)) * up[: high - low], out=total[1:])
            a, b = starts[first:last] - low, stops[first:last] - low
            hashes[first:last] = mix((total[b] - total[a]) * down[a] + (b - a).astype(U64) * U64(WORD_BASE))
        first = last
    return hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of the k words from each position; rows are not kept apart here."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for at in range(0, n, SEGMENT):
        part = hashes[at : min(n, at + SEGMENT) + k - 1]
        up, down = powers(WORD_BASE, len(part))
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - k + 1
        out[at : at + m] = mix((total[k:] - total[:m]) * down[:m] ^ U64(seed))
    return out


def blocked(df: DataFrame, text: str, block_bytes: int, block: str, place: str) -> DataFrame:
    """df with `block`, an id of a run of neighbouring rows with about block_bytes of text, and `place`, the row's place in
    its partition. A hash has at most one entry per block after deduplication there, so no hash is hot later on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, rows = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = np.diff(bytes_of(b.column(b.schema.get_field_index(text)))[1])
            ends = seen + np.cumsum(size)
            blk = (part << 32) + (ends - size) // block_bytes
            cols = [*b.columns, pa.array(blk, pa.int64()), pa.array(np.arange(rows, rows + len(size)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, block, place])
            seen, rows = (int(ends[-1]) if len(ends) else seen), rows + len(size)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(cut, f"{kept}, `{block}` long, `{place}` long")


def planes(values: np.ndarray) -> bytes:
    """uint32 numbers by byte place, which Spark's own compression makes small when the numbers are."""
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reached.

    Each round sends the smallest neighbouring label along every edge and then jumps to the label's label. Labels meet
    in aggregations with a map-side combine. The two joins around them have hot keys, a node with very many edges and a
    label of very many nodes; dealt_join spreads their rows. Each round's labels are a table in the shared folder.
    Isolated nodes have no row."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.count("*").alias("size")).select("node", F.least("node", "low").alias("component"), "size"), "labels")
    count, hubs = labels.count(), frequent(labels.select(F.col("node").alias("b"), "size"), 2 * edges.count())
    labels = labels.drop("size")
    while count:
        along = dealt_join(both, labels.withColumnRenamed("node", "b"), ["b"], hubs).select(F.col("a").alias("node"), "component")
        sent = along.unionByName(labels).groupBy("node").agg(F.min("component").alias("low"))
        sent = written(sent, "sent") if count > FEW else sent
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        nearer = spread(sent, up, "low", count).select("node", F.least("low", "root").alias("now"))
        new = written(nearer.join(labels, "node").selectExpr("node", "now as component", "now <> component as moved"), "labels")
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return labels
