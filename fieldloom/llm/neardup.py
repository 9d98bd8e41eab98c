"""Near-duplicate documents by Order MinHash.

A sketch samples shingles of a text, each labelled with how often it occurred before in the text. A slot keeps the KEEP
labelled shingles with the smallest hashes and their order in the text, so texts agree in a slot if they share those
shingles in one order and their lengths do not differ too much. Shingles have five words; edits leave few of these whole in
short texts, so there are slots of two words besides, 480 by the number of words, which fade out as texts grow. Texts that
share a slot are compared by banded alignment of their words: with L the length of the longest common subsequence of n and m
words, the similarity is L / (n + m - L), the order-keeping form of the Jaccard similarity, and texts are linked from 0.8.
Classes are the connected components of the links.

Equal texts are one node, so copies never meet each other. In a bucket, nodes are compared with one pivot. Where a pivot's
nodes are of several components still, links between the others are looked for without trying their pairs (see `opened`):
groups are split by the words in which nodes differ from the group's centre, until each is of one component. Two bounds decide
it, and both are exact, so no link between nodes that share a bucket is lost.

Texts are hashed in slices of about a megabyte, a longer text alone, so memory is bounded by the longest text. Texts of
fewer words than a shingle are one shingle. Null, empty and wordless texts are classes of their own, as are rows
without an id. Rows with equal ids are one document, linked if any of their texts are. Only ids, texts and result
columns are used, so extra columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, components, dealt_join, frequent, looked_up, mix, slices, unused, windows, words_of, written

SHINGLE = 5
#: Slots and shingles in each: where a tenth of the words are edited, two in five shingles of five words are shared.
SLOTS, KEEP = 28, 3
#: Shingles of two words have SHORT_SLOTS slots by the number of words, MOST_SHORT at most.
SHORT_SHINGLE, SHORT_SLOTS, MOST_SHORT = 2, 480, 32
#: A similarity of at least 0.8 is a distance n + m - 2 L of at most (n + m) / 9.
NINTHS = 9
#: So many nodes of a group outside its largest component are few; columns of parity bits, 64 in each.
FEW, BITS = 1000, [f"bits{k}_" for k in range(32)]
#: Nodes whose common words are the centre of a larger group, and nodes whose words tell which words are frequent.
CENTRE, FREQUENCIES = 3, 2000


def labelled(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The labelled shingles of each row in order, and each row's offsets among them."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= size, sizes - size + 1, np.minimum(sizes, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(ends[-1]) - ends[row] + offsets[row]
    full = windows(hashes, size, 3)
    got = full[np.minimum(place, max(len(full) - 1, 0))] if len(full) else np.zeros(len(place), U64)
    for i in np.flatnonzero((sizes > 0) & (sizes < size)):
        h = U64(sizes[i])
        for w in hashes[offsets[i] : offsets[i + 1]]:
            h = mix(np.array([h ^ w]))[0]
        got[ends[i]] = h
    order = np.lexsort((got, row))
    g, r = got[order], row[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(g))
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    label = np.zeros(len(g), U64)
    label[order] = again.astype(U64)
    return mix(got + label * U64(0xA24BAED4963EE407)), ends


def slots(h: np.ndarray, words: int, count: int, seed: int, keep: int = KEEP) -> list[int]:
    """Of each slot, a hash of the `keep` smallest labelled shingles in text order and of the text's length, which is cut
    into octaves, elsewhere in each slot. As many slots are made at once as a long text has room for."""
    out: list[int] = []
    step = max(1, (1 << 18) // max(1, len(h)))
    for first in range(0, count, step):
        j = np.arange(first, min(count, first + step))
        v = mix(h[None, :] ^ ((seed + j).astype(U64) * U64(0x9E3779B97F4A7C15))[:, None])
        at = np.sort(np.argpartition(v, keep, axis=1)[:, :keep], axis=1) if len(h) > keep else np.broadcast_to(np.arange(len(h)), v.shape)
        key = ((seed + j) * 64 + (np.log2(words) + j * 0.6180339887 % 1).astype(np.int64)).astype(U64)
        for x in np.take_along_axis(v, at, axis=1).T:
            key = key * U64(0x5851F42D4C957F2D) + x + (x >> U64(29))
            key ^= key >> U64(31)
        out += key.view(np.int64).tolist()
    return out


def sketch(words: np.ndarray, offsets: np.ndarray) -> list[list[int] | None]:
    """The slots of each row; none for a row without words."""
    long, ends = labelled(words, offsets)
    short, begins = labelled(words, offsets, SHORT_SHINGLE)
    out: list[list[int] | None] = []
    for i, n in enumerate(np.diff(offsets).tolist()):
        few = min(MOST_SHORT, -(-SHORT_SLOTS // n)) if n else 0
        out.append(slots(long[ends[i] : ends[i + 1]], n, SLOTS, 1) + slots(short[begins[i] : begins[i + 1]], n, few, 1001) if n else None)
    return out


def common(a: list[int], b: list[int], band: int) -> int:
    """The length of the longest common subsequence whose places in a and b are at most `band` apart. A row of the alignment is
    a bit string, in which a zero stands for a step."""
    places: dict[int, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    # At row j, bit k of the window stands for place j - band + k of a.
    full = window = (1 << 2 * band + 1) - 1
    out = 0
    for j, w in enumerate(b):
        if j:
            out += not window & 1 if j > band else 0
            window = window >> 1 | 1 << 2 * band
        if hit := places.get(w):
            met = window & (hit >> j - band if j >= band else hit << band - j) & full
            window = (window + met | window - met) & full
    return out + 2 * band + 1 - window.bit_count()


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """n + m - 2 L of two sequences; where their lengths or words alone put it above a ninth of n + m, a lower bound that is
    above it too. An alignment that is near enough lies within a band around the diagonal; only texts of the same words in
    another order need more than the band."""
    total = len(a) + len(b)
    if NINTHS * abs(len(a) - len(b)) > total:
        return abs(len(a) - len(b))
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = total - 2 * int(np.minimum(n[i], m[j]).sum())
    if NINTHS * least > total:
        return least
    short = min(len(a), len(b))
    other = np.flatnonzero(a[:short] != b[:short])
    first = int(other[0]) if len(other) else short
    other = np.flatnonzero(a[first:][::-1][: short - first] != b[first:][::-1][: short - first])
    last = int(other[0]) if len(other) else short - first
    inner = a[first : len(a) - last].tolist(), b[first : len(b) - last].tolist()
    found = total - 2 * (first + last + common(*inner, total // NINTHS))
    return found if NINTHS * found <= total else total - 2 * (first + last + common(*inner, total))


def elements(words: np.ndarray, frequent_words: dict[int, int]) -> np.ndarray:
    """The words of a text, each labelled with its occurrence, as even numbers in order: rare words before frequent ones.
    Different words may be one number, which makes texts differ in fewer elements and keeps every bound."""
    order = np.argsort(words, kind="stable")
    w = words[order]
    fresh = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
    at = np.arange(len(w))
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    rank = np.array([frequent_words.get(x, 0) for x in w.tolist()] if frequent_words else np.zeros(len(w)), U64)
    return np.unique((rank << U64(27)) | (mix(w + again.astype(U64) * U64(0xA24BAED4963EE407)) >> U64(38)) << U64(1)).astype(np.int32)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set, for each bit the parity of how many elements fall on it. Two sets differ in at least as many elements as
    their bits do."""
    place = [np.bincount((x >> 1) % (64 * len(BITS)), minlength=64 * len(BITS)) & 1 for x in sets]
    return np.packbits(np.array(place, np.uint8).reshape(len(sets), 64 * len(BITS)), axis=1).view("<i8")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id_col, class_id), the class the smallest id in it."""
    kind = df.schema[id_col].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(1)):
                c = b.slice(*part)
                keys = sketch(*words_of(c.column(1)))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(2), pa.array(keys, pa.list_(pa.int64()))], ["id", "h", "keys"])

    content = F.col(text_col)
    has_words = F.coalesce(F.col(id_col).isNotNull() & content.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    hashed = df.select(F.col(id_col).alias("id"), content.alias("text"), F.unhex(F.md5(content.cast("binary"))).alias("h"), has_words.alias("sound"))
    sound = hashed.where("sound").select("id", "h")
    # Equal texts are one node, the smallest of their ids; copies are combined before the shuffle. Texts that share an id are one
    # document, so they may share a node too.
    sketches = hashed.where("sound").select("id", "text", "h").mapInArrow(sketched, f"id {kind}, h binary, keys array<long>")
    nodes = written(sketches.groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("size"), F.any_value("keys").alias("keys")), "nodes")
    bucket = nodes.select(F.col("node").alias("h"), F.explode("keys").alias("key")).distinct()
    shared = written(bucket.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    live = written(looked_up(bucket, shared.withColumn("others", F.col("size")), "key"), "live")
    # The pivot of a bucket is the node that shares most: of a group of edited copies, the text they come from.
    degrees = live.groupBy("h").agg(F.sum("others").alias("degree"))
    ranked = live.join(degrees, "h").select("key", F.struct("degree", "h").alias("rank"))
    pivots = written(ranked.groupBy("key").agg(F.max("rank").alias("rank"), F.count("*").alias("size")).select("key", F.col("rank.h").alias("pivot"), "size"), "pivots")
    star = looked_up(live.select("key", "h"), pivots, "key").where("h <> pivot").select(F.col("h").alias("a"), F.col("pivot").alias("b")).distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(2)):
                c = b.slice(*part)
                words, ends = words_of(c.column(2))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([words[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])], pa.binary())], ["h", "of", "words"])

    # One text of each node that is compared, found by id and content, so that copies of it are spread by their ids.
    wanted = nodes.join(live.select(F.col("h").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("id"), "h")
    once = hashed.where("sound").join(wanted.hint("merge"), ["id", "h"], "left_semi").select("id", "h", "text")
    texts = written(once.mapInArrow(counted, f"h {kind}, of binary, words binary").dropDuplicates(["h", "of"]).drop("of"), "texts")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(b.column(2), b.column(3))]
            far = [distance(x, y) for x, y in pairs]
            near = pa.array([NINTHS * d <= len(x) + len(y) for d, (x, y) in zip(far, pairs)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), near, pa.array(far, pa.int64())], ["a", "b", "near", "distance"])

    def verified(pairs: DataFrame) -> DataFrame:
        """a has few pairs here, b may have any number."""
        left = texts.select(F.col("h").alias("a"), F.col("words").alias("words_a"))
        right = texts.select(F.col("h").alias("b"), F.col("words").alias("words_b"))
        hot = frequent(pairs.groupBy("b").agg(F.count("*").alias("size")), pairs.count())
        both = dealt_join(pairs.join(left, "a"), right, ["b"], hot).select("a", "b", "words_a", "words_b")
        return written(both.mapInArrow(aligned, f"a {kind}, b {kind}, near boolean, distance long"), "compared")

    compared = verified(written(star, "star"))
    reached = components(compared.where("near").select("a", "b"))
    # The pivot is compared with all of its nodes; what is left are the pairs of these.
    groups = compared.select(F.xxhash64("b").alias("g"), F.col("a").alias("h")).distinct()
    if not compared.where("not near").isEmpty():
        reached = opened(groups, texts, reached, verified)
    names = nodes.join(reached, "node", "left").select("h", "size", F.coalesce("component", "node").alias("class_of"))
    # Ids that stand on several rows tie their texts together.
    several = sound.groupBy("id").agg(F.min("h").alias("h1"), F.max("h").alias("h2")).where("h1 <> h2").select("id")
    if not several.isEmpty():
        ties = sound.join(several, "id").join(names, "h").select(F.col("id").alias("a"), F.col("class_of").alias("b"))
        tied = components(ties.unionByName(reached.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        names = names.join(tied.select(F.col("node").alias("class_of"), "component"), "class_of", "left").select("h", "size", F.coalesce("component", "class_of").alias("class_of"))
    # Wordless texts keep their ids and rows without an id have no class: neither takes part in the join.
    named = looked_up(sound, written(names, "names"), "h").select(F.col("id").alias(id_col), F.col("class_of").alias("class_id"))
    return named.unionByName(hashed.where("not sound").select(F.col("id").alias(id_col), F.col("id").alias("class_id")))


def opened(groups: DataFrame, texts: DataFrame, reached: DataFrame, verified) -> DataFrame:
    """Components after all links within groups (g, h) are found. A group is left as soon as its nodes are of one component.

    Where at most FEW nodes are outside the largest component, these are compared with the nodes of other components, but
    only if lengths and parity bits leave room for a link, which hardly any others' do. Of another group let the centre be the words that most of a few of its nodes have, and
    D a node's difference from it, the words that it has beyond the centre or lacks. Two nodes of n and m words differ by at
    least |D| + |E| - 2 |D and E|, and are linked only if that is at most (n + m) / 9. So

    - either |D| + |E| is at most (n + m) / 9. Then both are as near to the pivot, the node with the largest n / 9 - |D|, by
      their words, and are compared with it. Only the order of words can keep one from being linked to it. Those that are
      not, and others whose distances to the pivot leave room for a link with one of them, are a group of the next round;
    - or they share a word of D and E, and one of the n / 4 + 1 rarest of each, since linked texts are at most 5 : 4 as
      long. Each such word is a group of its own in the next round, with its own centre, to which the word then belongs. It is
      never all of the group, so rounds come to an end. Of words with the same nodes one is taken.

    So a passage that many texts share is in the centre, and what they have beside it decides. Both bounds are exact."""
    kind = texts.schema["h"].dataType.simpleString()
    sample = texts.orderBy(F.xxhash64("h")).limit(FREQUENCIES)  # any bounded sample does: it only orders words

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(1):
                w = np.unique(np.frombuffer(x.as_buffer(), U64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64())], ["w"])

    often = sample.mapInArrow(seen, "w long").groupBy("w").count().where("count > 3").collect()
    ranks = {x["w"] & 0xFFFFFFFFFFFFFFFF: min(15, x["count"].bit_length()) for x in often}

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                c = b.slice(k, 256)
                sets = [elements(np.frombuffer(x.as_buffer(), U64), ranks) for x in c.column(1)]
                size = pa.array([len(x.as_buffer()) // 8 for x in c.column(1)], pa.int64())
                bits = [pa.array(x, pa.int64()) for x in parities(sets).T]
                yield pa.RecordBatch.from_arrays([c.column(0), size, pa.array(sets, pa.list_(pa.int32())), *bits], ["h", "n", "x", *BITS])

    here = texts.join(groups.select("h").distinct(), "h", "left_semi").select("h", "words")
    words = written(here.mapInArrow(ordered, f"h {kind}, n long, x array<int>, {', '.join(f'{c} long' for c in BITS)}"), "words")
    several = [F.count("*").alias("size"), (F.min("component") < F.max("component")).alias("open")]
    edges = lambda links: links.where("near").select("a", "b").unionByName(reached.select(F.col("node").alias("a"), F.col("component").alias("b")))
    while True:
        told = groups.join(reached.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
        told = written(told, "told")
        parts = told.groupBy("g", "component").agg(F.count("*").alias("c"))
        live = parts.groupBy("g").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("top"))
        live = written(live.where("size > top.c").select("g", "size", F.col("top.component").alias("top"), (F.col("size") - F.col("top.c") <= FEW).alias("easy")), "open")
        members = written(looked_up(told, live, "g"), "members")
        near = members.where("easy").join(words.drop("x"), "h").drop("easy")
        one, two = (near.withColumnsRenamed({c: f"{c}{k}" for c in near.columns if c != "g"}) for k in (1, 2))
        differ = sum((F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in BITS), F.lit(0))
        room = F.greatest(differ, F.abs(F.col("n1") - F.col("n2"))) * NINTHS <= F.col("n1") + F.col("n2")
        once = (F.col("component1") != F.col("component2")) & ((F.col("component2") == F.col("top2")) | (F.col("h1") < F.col("h2")))
        # A group's nodes are dealt over shares, and the few outside its largest component are copied to each share.
        hot = frequent(live.where("easy").select("g", "size"), live.where("easy").agg(F.sum("size")).first()[0] or 0)
        met = dealt_join(two, one.where("component1 <> top1"), ["g"], hot)
        tried = met.where(once & room).select(F.col("h2").alias("a"), F.col("h1").alias("b")).distinct()
        large = written(live.where("not easy").select("g", "size"), "large")
        if large.isEmpty():
            tried = written(tried, "pairs")
            return reached if tried.isEmpty() else components(edges(verified(tried)))
        members = members.where("not easy").drop("easy", "top")
        few = members.select("g", "h").withColumn("k", F.row_number().over(W.partitionBy("g").orderBy("h"))).where(F.col("k") <= CENTRE)
        few = few.join(words.select("h", "x"), "h").select("g", F.explode("x").alias("x"))
        centre = few.groupBy("g", "x").agg(F.count("*").alias("c")).where(2 * F.col("c") > CENTRE).groupBy("g").agg(F.collect_list("x").alias("centre"))
        centre = written(large.join(centre, "g", "left").select("g", F.coalesce("centre", F.array().cast("array<int>")).alias("centre"), "size"), "centres")
        apart = F.array_sort(F.concat(F.array_except("x", "centre"), F.transform(F.array_except("centre", "x"), lambda v: v + 1)))
        placed = looked_up(members.join(words.select("h", "n", "x"), "h"), centre, "g").select("g", "h", "component", "n", apart.alias("d"))
        rarest = F.slice("d", 1, F.floor(F.col("n") / 4).cast("int") + 1)
        placed = written(placed.withColumns({"slack": F.col("n") - NINTHS * F.size("d"), "d": rarest}), "placed")
        best = placed.groupBy("g").agg(F.max(F.struct("slack", "h", "component")).alias("p"), F.count("*").alias("size"))
        best = written(best.select("g", F.col("p.h").alias("pivot"), F.col("p.slack").alias("room"), F.col("p.component").alias("of"), "size"), "best")
        core = looked_up(placed.drop("d"), best, "g").where((F.col("h") != F.col("pivot")) & (F.col("slack") + F.col("room") >= 0))
        core = written(core, "core")
        ends = [F.col("h").alias("a"), F.col("pivot").alias("b")]
        other = F.col("component") != F.col("of")
        more = verified(written(tried.unionByName(core.where(other).select(*ends)).distinct(), "pairs"))
        reached = components(edges(more))
        far = core.where(other).join(more.withColumnsRenamed({"a": "h", "b": "pivot"}), ["h", "pivot"])
        least = written(far.where("not near").groupBy("g").agg(F.min(NINTHS * F.col("distance") - F.col("n")).alias("least"), F.count("*").alias("size")), "least")
        rest = groups.limit(0)
        if not least.isEmpty():
            # Nodes of the pivot's own component have to be near enough to the far ones too.
            own = core.where(~other).join(least.select("g"), "g", "left_semi")
            said = verified(written(own.select(*ends).distinct(), "own")).withColumnsRenamed({"a": "h", "b": "pivot"})
            all_of = far.select("g", "h", "pivot", "n", "distance").unionByName(own.join(said, ["h", "pivot"]).select("g", "h", "pivot", "n", "distance"))
            rest = looked_up(all_of, least, "g").where(NINTHS * F.col("distance") + F.col("n") >= F.col("least")).select(F.xxhash64("g", "pivot").alias("g"), "h")
        each = written(placed.select("g", "h", "component", F.explode("d").alias("x")), "differing")
        split = each.groupBy("g", "x").agg(*several, F.struct(F.bit_xor(F.xxhash64("h")), F.try_sum(F.shiftright(F.xxhash64("h"), 24))).alias("nodes")).where("open")
        split = split.groupBy("g", "nodes", "size").agg(F.min("x").alias("x")).select("g", "x", "size")
        parts = looked_up(each.select("g", "x", "h"), written(split, "split"), ["g", "x"]).select(F.xxhash64("g", "x").alias("g"), "h")
        groups = written(parts.unionByName(rest), "groups")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose class has a smaller id, and with rows of equal id and text once."""
    h, lost = unused(df, "_h"), unused(df, "_lost")
    gone = classes(df, id_col, text_col).where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias(lost)).distinct()
    kept = df.withColumn(h, F.md5(F.col(text_col).cast("binary"))).join(gone, F.col(id_col) == F.col(lost), "left_anti")
    return kept.dropDuplicates([id_col, h]).drop(h)
