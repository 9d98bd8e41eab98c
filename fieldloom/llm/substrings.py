"""Exact substring deduplication by difference-cover anchors.

A window is `length` consecutive words of one text. Hashes are taken only at word positions that lie in a difference
cover modulo a period: for any two positions some shift below the period brings both onto the cover, so two equal
windows always share an anchor of length - period + 1 words at the same place. Anchors that occur twice extend: only
window starts they can belong to are hashed in full, and a window is repeated if its hash starts twice. Words under a
repeated window go; windows are judged on the input.

Both counts run on packed arrays: a block of neighbouring documents sends each distinct hash once to the hash's bucket
and gets back the places that are repeated, so a passage of a third of all documents has one entry per block.

Null and empty texts have no words and keep none; texts shorter than a window stay whole; repeated rows are texts like
any others, and so remove each other; an empty table gives an empty table. All columns of the input are kept; result
columns replace input columns of the same name. A block is hashed and cut in slices of about a megabyte, a longer text
alone, so memory is bounded by a block's bytes and what its longest text takes.

Words are numbered by their order in the input's partitions, and the blocks are one exchange that is read three times. So
that a lost executor's rows come back in the same order, the input has to be a stored table or an expression of one.
A false repeat needs two different anchors and two different windows that agree in 64-bit hashes, which start from
different hashes of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_BASE, OTHER_BASE, U64, blocked, partitions, planes, slices, unplanes, unused, windows, words_of

#: Period and cover: every difference modulo 21 is one of two members of the cover (a perfect difference set).
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
LENGTH = 35
BLOCK_BYTES = 8 << 20
BUNDLES = "_bucket int, _blk long, hashes binary, places binary"


def bundles(blk: int, hashes: np.ndarray, places: np.ndarray, buckets: int) -> pa.Table:
    """The distinct hashes of a block by bucket with one place each; places repeated within it need no partner."""
    order = np.argsort(hashes, kind="stable")
    h, p = hashes[order], places[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    size = np.diff(np.append(np.flatnonzero(first), len(h)))
    known = np.sort(p[np.repeat(size > 1, size)])
    h, p = h[first], p[first]
    bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
    order = np.lexsort((p, bucket))
    h, p, bucket = h[order], p[order], bucket[order]
    some, starts = np.unique(bucket, return_index=True)
    ends = [*starts[1:].tolist(), len(h)]
    rows = [(int(b), h[s:e].tobytes(), planes(np.diff(p[s:e], prepend=0))) for b, s, e in zip(some, starts.tolist(), ends)]
    if len(known):
        rows.append((int(blk) % buckets, b"", planes(np.diff(known, prepend=0))))
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.table({"_bucket": pa.array(cols[0], pa.int32()), "_blk": pa.array([blk] * len(rows), pa.int64()), "hashes": pa.array(cols[1], pa.binary()), "places": pa.array(cols[2], pa.binary())})


def repeated(df: DataFrame, n: int) -> DataFrame:
    """Of bundles, rows (_blk, places): the places whose hash another block has too, or that were repeated within one."""

    def meet(t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        owner = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        h = np.concatenate(hashes)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        ends = np.searchsorted(owner, np.arange(1, len(hashes) + 1))
        out, at = [], 0
        for data, own, end in zip(t.column("places").to_pylist(), hashes, ends.tolist()):
            if not len(own):
                out.append(data)
            else:
                places = np.cumsum(unplanes(data))[twice[at:end]]
                out.append(planes(np.diff(places, prepend=0)) if len(places) else None)
            at = end
        return pa.table({"_blk": t.column("_blk"), "places": pa.array(out, pa.binary())}).filter(pa.array([x is not None for x in out], pa.bool_()))

    return df.repartition(n, "_bucket").groupBy("_bucket").applyInArrow(meet, "_blk long, places binary").repartition(n, "_blk")


def met(right: pa.Table) -> np.ndarray:
    """The places of a block in order, each once."""
    places = [np.cumsum(unplanes(x)) for x in right.column("places").to_pylist()]
    return np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)


def spread(starts: np.ndarray, offsets: np.ndarray, before: int, after: int) -> np.ndarray:
    """True from `before` places before each start to `after` places after it."""
    step = np.zeros(offsets[-1] + after + 1, np.int64)
    np.add.at(step, np.maximum(starts - before, 0), 1)
    np.add.at(step, starts + after + 1, -1)
    return np.cumsum(step)[: offsets[-1]] > 0


def hashed(texts: pa.Array | pa.ChunkedArray, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each slice of a block: the place of its first word in the block, its words' hashes, its rows' offsets among them."""
    at = 0
    for part in slices(texts, rows=len(texts)):
        hashes, offsets = words_of(texts.slice(*part), base)
        yield at, hashes, offsets
        at += len(hashes)


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))


def anchors(texts: pa.Array | pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a block's anchors on the cover."""
    anchor, on_cover, out = length - PERIOD + 1, np.isin(np.arange(PERIOD), COVER), []
    for at, hashes, offsets in hashed(texts, BYTE_BASE):
        got = windows(hashes, anchor, 1)
        place = np.arange(len(got))
        row = np.searchsorted(offsets, place, "right") - 1
        fits = on_cover[(place - offsets[row]) % PERIOD] & (place + anchor <= offsets[row + 1]) & (offsets[row + 1] - offsets[row] >= length)
        out.append((got[fits], place[fits] + at))
    return joined(out)


def extended(texts: pa.Array | pa.ChunkedArray, found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a block's windows that may hold one of the found anchors."""
    out = []
    for at, hashes, offsets in hashed(texts, OTHER_BASE):
        here = found[np.searchsorted(found, at) : np.searchsorted(found, at + len(hashes))] - at
        if not len(here):
            continue
        got = windows(hashes, length, 2)
        place = np.flatnonzero(spread(here, offsets, PERIOD - 1, 0)[: len(got)])
        row = np.searchsorted(offsets, place, "right") - 1
        place = place[place + length <= offsets[row + 1]]
        out.append((got[place], place + at))
    return joined(out)


def cut(texts: pa.Array | pa.ChunkedArray, found: np.ndarray, length: int) -> tuple[list[int], list[int], list[bytes]]:
    """Of each row: its words, how many of them are in a window that starts at a found place, and the others."""
    n_words, n_removed, kept, at = [], [], [], 0
    for part in slices(texts, rows=len(texts)):
        words = [x.split() if x else [] for x in texts.slice(*part).cast(pa.large_binary()).to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        stop = at + int(offsets[-1])
        gone = spread(found[np.searchsorted(found, at) : np.searchsorted(found, stop)] - at, offsets, 0, length - 1)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[offsets[1:]] - total[offsets[:-1]]
        for i, w in enumerate(words):
            if removed[i]:
                keep = ~gone[offsets[i] : offsets[i + 1]]
                w = [w[j] for j in np.flatnonzero(keep).tolist()]
            kept.append(b" ".join(w))
        n_words += sizes.tolist()
        n_removed += removed.tolist()
        at = stop
    return n_words, n_removed, kept


def without_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with n_words, n_removed and kept_text, the kept words joined by one space. block_bytes bounds a task's memory."""
    if length < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    n = partitions(df.sparkSession)
    buckets = 4 * n
    names = df.columns

    # One exchange, read three times: nothing between may prune or filter, or it would be made again.
    block, place_col = unused(df, "_blk"), unused(df, "_row")
    blocks = blocked(df, text_col, block_bytes, block, place_col).repartition(n, block)

    def anchored(t: pa.Table) -> pa.Table:
        t = t.sort_by(place_col)
        return bundles(t.column(block)[0].as_py(), *anchors(t.column(text_col), length), buckets)

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"_bucket": pa.array([], pa.int32()), "_blk": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})
        t = left.sort_by(place_col)
        return bundles(t.column(block)[0].as_py(), *extended(t.column(text_col), met(right), length), buckets)

    def kept_of(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by(place_col)
        n_words, n_removed, kept = cut(t.column(text_col), met(right), length)
        out = {c: t.column(c) for c in names}
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table({c: out[c] for c in result})

    result = [*(c for c in names if c not in ("n_words", "n_removed", "kept_text")), "n_words", "n_removed", "kept_text"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in result[:-3])
    found = repeated(blocks.groupBy(block).applyInArrow(anchored, BUNDLES), n)
    again = repeated(blocks.groupBy(block).cogroup(found.groupBy("_blk")).applyInArrow(judged, BUNDLES), n)
    return blocks.groupBy(block).cogroup(again.groupBy("_blk")).applyInArrow(kept_of, f"{kept}, n_words long, n_removed long, kept_text string")
