"""Token counts of whole texts by overlap resynchronisation.

Every text is encoded in overlapping chunks with offsets. Neighbouring chunks are spliced at a place that starts a
token in both and follows white space: the tokenizer's pattern never matches white space, so tokens on either side of
it do not depend on each other. Where an overlap has no such place it is widened, and then the chunk, to the whole text
at worst. A text that ends within its first chunk has nothing to splice. Memory is bounded by a text and its chunks.

Null texts are empty; repeated rows give a row each; an empty table gives an empty table. Extra columns are kept, and
result columns replace columns of the same name.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import ChainMap
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of an overlap.
CHUNK, OVERLAP = 1 << 11, 1 << 7
LIMIT = 2048
#: str.isspace holds for these, which are no white space for the tokenizer.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: Words kept with their tokens by each worker, and the characters of the longest of them: these bound its memory.
WORDS, LONGEST = 1 << 18, 48
_WORD, _CONTROL = re.compile(r"\S+"), re.compile(f"[{CONTROLS}]")


class Encoder:
    """Where each token of a text starts, in characters. A text that is composed already, and whose lower case has its
    characters one by one, goes to a copy of the tokenizer without its normalizer. There tokens on either side of white space
    do not depend on each other, so a word that was met before is not encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.whole, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.whole, self.bare):
            t.no_truncation()
            t.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, tuple[int, ...]] = {}
        self.shapes: dict[tuple[int, ...], tuple[int, ...]] = {}

    def lowered(self, text: str) -> str | None:
        """The text as the normalizer leaves it, white space apart, or None where only the whole tokenizer tells."""
        low = text.lower()
        plain = len(low) == len(text) and "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        return low if plain and not _CONTROL.search(low) and not any(s in low for s in self.special) else None

    def tokens(self, words: list[str]) -> Mapping[str, tuple[int, ...]]:
        """Where the tokens of each word start in it. New words are encoded together."""
        new = set(words).difference(self.known)
        if not new:
            return self.known
        if len(self.known) > WORDS:
            self.known, self.shapes = {}, {}
            new = set(words)
        # Words whose tokens start alike share them.
        at, first, long, shapes = 0, 0, {}, self.shapes
        starts = [a for a, _ in self.bare.encode(" ".join(new), add_special_tokens=False).offsets]
        n = len(starts)
        for w in new:
            end, last = at + len(w), first
            while last < n and starts[last] < end:
                last += 1
            shape = tuple([a - at for a in starts[first:last]])
            if len(w) <= LONGEST:
                self.known[w] = shapes.setdefault(shape, shape)
            else:
                long[w] = shape
            at, first = end + 1, last
        return ChainMap(long, self.known) if long else self.known

    def starts(self, text: str) -> list[int]:
        low = self.lowered(text)
        if low is None:
            return [a for a, _ in self.whole.encode(text, add_special_tokens=False).offsets]
        tokens, out = self.tokens(low.split()), []
        for m in _WORD.finditer(low):
            at, shape = m.start(), tokens[m[0]]
            if len(shape) == 1:
                out.append(at)
            else:
                out += [at + a for a in shape]
        return out

    def count(self, text: str) -> int:
        """The number of starts."""
        low = self.lowered(text)
        if low is None:
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        words = low.split()
        return sum(map(len, map(self.tokens(words).__getitem__, words)))

    def encode(self, text: str, **options):
        return self.whole.encode(text, **options)


@lru_cache(2)
def tokenizer(path: str) -> Encoder:
    return Encoder(path)


def blank(c: str) -> bool:
    return c.isspace() and c not in CONTROLS


def spliced(t: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text, from chunks of it."""
    if len(text) <= chunk:
        return t.count(text)
    total, begin, size, got = 0, 0, chunk, None
    low = 0  # tokens from here on are not counted yet
    while True:
        end = min(len(text), begin + size)
        got = [begin + a for a in t.starts(text[begin:end])] if got is None else got
        if end == len(text):
            return total + len(got) - bisect_left(got, low)
        width = overlap
        while True:
            following = max(begin + 1, end - width)
            after = [following + a for a in t.starts(text[following : min(len(text), following + chunk)])]
            both = set(got).intersection(after)
            place = next((p for p in range(end - 1, max(following, low), -1) if p in both and blank(text[p - 1])), None)
            if place is not None or following == begin + 1:
                break
            width *= 2
        if place is None:
            size, got = 2 * size, None
            continue
        total += bisect_left(got, place) - bisect_left(got, low)
        begin, low, size, got = following, place, chunk, after


class Counter:
    """The numbers of tokens of texts."""

    def __init__(self, t: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.t, self.chunk, self.overlap = t, chunk, overlap

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        return [spliced(self.t, x or "", self.chunk, self.overlap) for x in texts]


def token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer(tokenizer_path), chunk, overlap)
        for b in batches:
            n = counter.counts(x.as_py() for x in b.column(b.schema.get_field_index(text_col)))
            cols = {c: b.column(i) for i, c in enumerate(b.schema.names)} | {"n_tokens": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    kept = [f for f in df.schema.fields if f.name not in ("n_bytes", "n_tokens", "over_limit")]
    names = [*(f.name for f in kept), "n_tokens"]
    counted = df.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens long")
    return counted.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})
