"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Each block of neighbouring documents keeps its pre-tokens as positions into the block's own list of distinct words.
Those words travel by hash, are encoded once where they meet, and their ids travel back to the block, which puts them
together by position. A word has one entry per block, however frequent it is, so no word is hot.

Nulls are empty texts (no ids); repeated rows, repeated ids and null ids of documents give a row each; an empty table
gives an empty table. Only the id column and the result columns are returned, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, planes, unplanes

#: Pre-tokens of a block; a longer document is a block of its own.
BLOCK_WORDS = 1 << 21


@lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bounded by the vocabulary, whatever the input."""
    with open(path, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def pack_words(words: list[str], numbers: np.ndarray) -> bytes:
    import zstandard

    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    head = np.array([len(raw)], "<u4").tobytes()
    return zstandard.compress(head + planes(sizes) + planes(np.diff(numbers, prepend=0)) + b"".join(raw), 1)


def unpack_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    import zstandard

    data = zstandard.decompress(data)
    n = int(np.frombuffer(data[:4], "<u4")[0])
    sizes, numbers = unplanes(data[4 : 4 + 4 * n]), np.cumsum(unplanes(data[4 + 4 * n : 4 + 8 * n]))
    ends = (np.cumsum(sizes) + 4 + 8 * n).tolist()
    return [data[e - s : e] for e, s in zip(ends, sizes.tolist())], numbers


def pack_places(places: np.ndarray) -> bytes:
    """Numbers of words in order of frequency: one byte for the most frequent 255, more for the others."""
    import zstandard

    rare = places[places >= 255] - 255
    rarer = rare[rare >= 65535]
    parts = np.minimum(places, 255).astype("u1"), np.minimum(rare, 65535).astype("<u2"), rarer.astype("<u4")
    return np.array([len(places), len(rare)], "<u8").tobytes() + zstandard.compress(b"".join(p.tobytes() for p in parts), 1)


def unpack_places(data: bytes) -> np.ndarray:
    import zstandard

    n, m = np.frombuffer(data[:16], "<u8").astype(int)
    raw = zstandard.decompress(data[16:])
    places = np.frombuffer(raw[:n], "u1").astype(np.int64)
    rare = np.frombuffer(raw[n : n + 2 * m], "<u2").astype(np.int64)
    rare[rare == 65535] = np.frombuffer(raw[n + 2 * m :], "<u4")
    places[places == 255] = rare + 255
    return places


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (id_col, ids array<int>): the ids of each whole text by the rank file at `ranks`, each match of `pattern`
    encoded separately, without special tokens. block_words bounds a task's memory."""
    spark = df.sparkSession
    n = partitions(spark)
    buckets = 2 * n
    kind = df.schema[id_col].dataType.simpleString()

    def pretokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        part, block = TaskContext.get().partitionId() << 32, 0
        ids, counts, table, places = [], [], {}, []

        def out() -> pa.RecordBatch:
            nonlocal ids, counts, table, places, block
            at = np.concatenate(places) if places else np.zeros(0, np.int64)
            order = np.argsort(-np.bincount(at, minlength=len(table)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = list(table)
            by: list[list[int]] = [[] for _ in range(buckets)]
            for number, k in enumerate(order.tolist()):
                by[zlib.crc32(words[k].encode()) % buckets].append(number)
            packed = [pack_words([words[order[i]] for i in numbers], np.array(numbers)) if numbers else None for numbers in by]
            cols = [pa.array([part + block]), pa.array([ids], pa.list_(id_type)), pa.array([counts], pa.list_(pa.int32())), pa.array([pack_places(rank[at])], pa.binary()), pa.array([packed], pa.list_(pa.binary()))]
            ids, counts, table, places, block = [], [], {}, [], block + 1
            return pa.RecordBatch.from_arrays(cols, ["_blk", "ids", "counts", "places", "words"])

        held = 0
        for b in batches:
            id_type = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = find(text.as_py() or "")
                if held and held + len(found) > block_words:
                    yield out()
                    held = 0
                number = table.setdefault
                places.append(np.fromiter((number(w, len(table)) for w in found), np.int64, len(found)))
                ids.append(key)
                counts.append(len(found))
                held += len(found) + 1
        if ids:
            yield out()

    # One exchange, read by both of what follows: nothing between may prune or filter, or it would be made twice.
    blocks = (
        df.select(id_col, text_col)
        .mapInArrow(pretokens, f"_blk long, ids array<{kind}>, counts array<int>, places binary, words array<binary>")
        .repartition(n, "_blk")
    )

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blk, words in zip(b.column(0).to_pylist(), b.column(4)):
                bucket = [i for i, w in enumerate(words) if w.is_valid]
                cols = [pa.array(bucket, pa.int32()), pa.array([blk] * len(bucket), pa.int64()), words.values.drop_null() if bucket else pa.array([], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["_bucket", "_blk", "words"])

    def encoded(t: pa.Table) -> pa.Table:
        piece, known, out = encoding(ranks, pattern)._encode_single_piece, {}, []
        for data in t.column("words").to_pylist():
            words, numbers = unpack_words(data)
            each = []
            for w in words:
                if (got := known.get(w)) is None:
                    got = known[w] = piece(w)
                each.append(got)
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((i for e in each for i in e), np.int64, int(sizes.sum()))
            out.append(np.array([len(each)], "<u4").tobytes() + planes(np.diff(numbers, prepend=0)) + planes(sizes) + planes(flat))
        return pa.table({"_blk": t.column("_blk"), "coded": pa.array(out, pa.binary())})

    coded = (
        blocks.mapInArrow(words_out, "_bucket int, _blk long, words binary").repartition(n, "_bucket")
        .groupBy("_bucket").applyInArrow(encoded, "_blk long, coded binary").repartition(n, "_blk")
    )

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, sizes, flat = [], [], []
        for data in right.column("coded").to_pylist():
            m = int(np.frombuffer(data[:4], "<u4")[0])
            numbers.append(np.cumsum(unplanes(data[4 : 4 + 4 * m])))
            sizes.append(unplanes(data[4 + 4 * m : 4 + 8 * m]))
            flat.append(unplanes(data[4 + 8 * m :]))
        keys, out = [], []
        if numbers:
            number, size = np.concatenate(numbers), np.concatenate(sizes)
            ids = np.concatenate(flat).astype(np.int32)
            begin, length = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
            begin[number], length[number] = np.cumsum(size) - size, size
        for i in range(left.num_rows):
            counts = np.array(left.column("counts")[i].as_py(), np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            places = unpack_places(left.column("places")[i].as_py())
            if len(places):
                long = length[places]
                stops = np.concatenate([[0], np.cumsum(long)])
                flat_ids = ids[np.repeat(begin[places] - stops[:-1], long) + np.arange(stops[-1])]
                offsets = stops[ends]
            else:
                flat_ids, offsets = np.zeros(0, np.int32), ends
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat_ids, pa.int32())))
            keys.append(left.column("ids")[i].values)
        return pa.table({id_col: pa.chunked_array(keys), "ids": pa.chunked_array(out)})

    return blocks.groupBy("_blk").cogroup(coded.groupBy("_blk")).applyInArrow(together, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the bytes of the ids in ids_col, joined with the token-byte table, which each task holds whole
    (it is bounded by the vocabulary). Null ids give null, unknown ids no bytes; a column named out_col is replaced."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        size = len(table)
        for b in batches:
            out = []
            for ids in b.column(b.schema.get_field_index(ids_col)):
                got = None if not ids.is_valid else ids.values.fill_null(size).to_numpy().tolist()
                try:
                    out.append(None if got is None else b"".join(map(table.__getitem__, got)))
                except IndexError:
                    out.append(b"".join(table[i] for i in got if 0 <= i < size))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary())], [*names, out_col])

    names = [c for c in df.columns if c != out_col]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)
    return df.mapInArrow(look_up, f"{kept}, `{out_col}` binary")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows (doc_id, ids, decoded)."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
