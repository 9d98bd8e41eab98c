"""Best-fit packing of tokenised documents into sequences, by large-item matching.

Documents above a third of the capacity come two to a sequence at most: from the largest down, each is matched with the
largest other one that fits beside it. Smaller documents then fill the tightest gaps, largest first.

The plan is made on the histogram of lengths, which has at most `capacity` entries whatever the input: pieces of one
length are interchangeable, so a step packs a run of their ranks at once. Pieces take their ranks from counts per task
and length, and look their places up in the plan, whose size is bounded by the capacity too.

Null texts are empty (only the closing id); repeated rows and ids are documents of their own; an empty table gives an
empty table. Only ids, texts and result columns are used, so extra columns cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import encoding
from .common import small, written

CAPACITY = 2048
SEGMENTS = "length int, first long, last long, each long, base long, at long"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, last rank + 1, pieces per sequence, first sequence, offset in each sequence)."""
    left, next_rank, out, bins = {k: v for k, v in histogram.items() if v}, defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps: list[int] = []

    def put(length: int, base: int, sequences: int, each: int, at: int) -> None:
        n = sequences * each
        out.append((length, next_rank[length], next_rank[length] + n, each, base, at))
        next_rank[length] += n
        left[length] -= n

    def leave(gap: int, base: int, sequences: int) -> None:
        if gap and sequences:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((base, sequences))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else None
        if b is None or (b == a and left[a] < 2):
            b = large[k - 1] if b is not None and k else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        if b == a:
            put(a, bins, n, 2, 0)
        else:
            put(a, bins, n, 1, 0)
            if b is not None:
                put(b, bins, n, 1, a)
        leave(capacity - a - (b or 0), bins, n)
        bins += n
        large = [x for x in large if left[x]]
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(open_gaps, s)
            if i == len(open_gaps):
                n = -(-left[s] // (capacity // s))
                leave(capacity, bins, n)
                bins += n
                continue
            gap = open_gaps[i]
            base, sequences = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(i)
            each = gap // s
            full = min(sequences, left[s] // each)
            if full:
                put(s, base, full, each, capacity - gap)
                leave(gap - each * s, base, full)
            rest = left[s] if full < sequences else 0
            if rest:
                put(s, base + full, 1, rest, capacity - gap)
                leave(gap - rest * s, base + full, 1)
            leave(gap, base + full + bool(rest), sequences - full - bool(rest))
    return out


def pieces(df: DataFrame, ranks: str, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) and each piece's task and rank among its task's pieces of that
    length. `ranks` holds the vocabulary of `tokenizer` for a faster library; texts with a special string go to
    `tokenizer` itself, which gives them an id of their own."""
    kind = df.schema[id_col].dataType.simpleString()

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        encode = encoding(ranks, pattern).encode_ordinary
        part, ranked = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            keys: list[int] = []
            for k, text in enumerate(b.column(1)):
                x = text.as_py() or ""
                ids = whole.encode(x, add_special_tokens=False).ids if any(s in x for s in special) else encode(x)
                ids = np.array([*ids, 0], "<u4")
                stop = (len(ids) - 1) % capacity + 1
                start = piece = 0
                while start < len(ids):
                    rows.append((piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), part, int(ranked[stop - start])))
                    keys.append(k)
                    ranked[stop - start] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            cols = [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 6
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c).cast(t) for c, t in zip(cols, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return df.select(id_col, text_col).mapInArrow(tokenised, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long")


def packed(df: DataFrame, ranks: str, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    # Ranks have to be the same whenever they are read again, so the pieces are a table.
    table = written(pieces(df, ranks, tokenizer, pattern, id_col, text_col, capacity), "pieces")
    counts = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = counts.selectExpr("task", "length", "sum(n) over (partition by length order by task rows unbounded preceding) - n as before")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = small(spark, plan(histogram, capacity), StructType.fromDDL(SEGMENTS))
    numbered = table.join(before, ["task", "length"]).withColumn("r", F.col("before") + F.col("rank"))
    place = F.broadcast(segments.withColumnRenamed("length", "l"))  # bounded by the capacity
    return numbered.join(place, (F.col("length") == F.col("l")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("last"))).selectExpr(
        "doc_id", "piece", "start", "length", "ids_crc32",
        "base + (r - first) div each as sequence_id",
        "at + ((r - first) % each) * length as offset",
    )
