"""Merkle fixity audit of WARC archives and their replicas, on DataFrame functions.

Records are hashed; ordered ranges of offsets are hashed over the hashes in them, ranges of RANGE bytes first and then
FAN_OUT ranges to one, up to a root for each volume. Replicas are compared by their roots, and only the ranges that
differ are descended, level by level, down to the records.

Null urls and bodies are empty; rows without an id are in volumes by a hash of their content; equal rows are records of
their own, told apart by their order; an empty table gives an empty table. Extra columns are not read. A record is one row
while it is hashed, however long, and does not leave its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Ids of a volume; bytes of the lowest ranges; ranges to a range of the next level.
VOLUME, RANGE, FAN_OUT = 1000, 1 << 16, 16
#: The date in the headers of records, where a table has none: a fixed one keeps their bytes the same in every run.
DATE = "1970-01-01T00:00:00Z"


def record(url: Column, body: Column, date: str = DATE) -> Column:
    """The bytes of a WARC record, as text: its id is made from its content, so equal records have equal bytes."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    h = F.md5(F.concat(url, F.lit(" "), body).cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    lines = [F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat_ws("\r\n", *lines, F.lit(""), body, F.lit(""), F.lit(""))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = DATE, copy: Column | None = None, lost: Column | None = None) -> DataFrame:
    """The manifest of an archive: rows (volume, offset, length, sha256, id) of its records. With `copy`, a replica's bytes
    as an expression of `record` and `id`, also copy_length and copy_sha256 of these at the same place; with `lost` (of
    `id`) whether the replica lacks the record. No record moves: lengths and hashes are taken where it is read."""
    made = pages.select(F.col(id_col).alias("id"), record(F.col(url_col), F.col(body_col), date).alias("record"))
    hashed = lambda r, name: [F.octet_length(r).cast("long").alias(f"{name}length"), F.sha2(r.cast("binary"), 256).alias(f"{name}sha256")]
    more = ([] if copy is None else hashed(copy, "copy_")) + ([] if lost is None else [lost.alias("lost")])
    made = made.select("id", *hashed(F.col("record"), ""), *more)
    # Rows without an id go by their content to as many volumes as keep each at about VOLUME records.
    strays = max(1, -(-pages.where(F.col(id_col).isNull()).count() // VOLUME))
    volume = F.coalesce(F.floor(F.col("id") / VOLUME), -1 - F.pmod(F.xxhash64("sha256"), F.lit(strays))).cast("long")
    order = W.partitionBy("volume").orderBy("id", "sha256").rowsBetween(W.unboundedPreceding, -1)
    made = made.withColumn("volume", volume).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return made.select("volume", "offset", "length", "sha256", "id", *(c for c in made.columns if c.startswith("copy_") or c == "lost"))


def levels(manifest: DataFrame) -> int:
    """Levels above the records, such that one range of the last holds any volume."""
    last = manifest.agg(F.max("offset")).first()[0] or 0
    n = 1
    while RANGE * FAN_OUT ** (n - 1) <= last:
        n += 1
    return n


def tree(manifest: DataFrame, height: int) -> list[DataFrame]:
    """Tables (volume, node, hash) of each level, the lowest first."""
    leaf = F.concat_ws(":", F.col("offset"), F.col("length"), F.col("sha256"))
    out, below = [], manifest.select("volume", F.floor(F.col("offset") / RANGE).alias("node"), F.col("offset").alias("place"), leaf.alias("hash"))
    for _ in range(height):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
        level = written(below.groupBy("volume", "node").agg(F.sha2(F.array_join(ordered, "|").cast("binary"), 256).alias("hash")), "level")
        out.append(level)
        below = level.select("volume", F.floor(F.col("node") / FAN_OUT).alias("node"), F.col("node").alias("place"), "hash")
    return out


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.alias("l").join(right.alias("r"), ["volume", "node"], "full")
    return both.where(~F.col("l.hash").eqNullSafe(F.col("r.hash"))).select("volume", "node")


def audit(manifest: DataFrame, replica: DataFrame) -> DataFrame:
    """Rows (volume, offset, status) of the records that differ: corrupt, missing or extra in the replica."""
    height = max(levels(manifest), levels(replica))
    ours, theirs = tree(manifest, height), tree(replica, height)
    wrong = differing(ours[-1], theirs[-1])
    for k in range(height - 2, -1, -1):
        up = wrong.withColumnRenamed("node", "parent")

        def under(level: DataFrame, up: DataFrame = up) -> DataFrame:
            return level.withColumn("parent", F.floor(F.col("node") / FAN_OUT)).join(up, ["volume", "parent"], "left_semi").select("volume", "node", "hash")

        wrong = written(differing(under(ours[k]), under(theirs[k])), "wrong")
    inside = lambda m: m.withColumn("node", F.floor(F.col("offset") / RANGE)).join(wrong, ["volume", "node"], "left_semi").select("volume", "offset", "length", "sha256")
    l, r = inside(manifest).alias("l"), inside(replica).alias("r")
    status = F.when(F.col("r.sha256").isNull(), "missing").when(F.col("l.sha256").isNull(), "extra").when((F.col("l.sha256") != F.col("r.sha256")) | (F.col("l.length") != F.col("r.length")), "corrupt")
    return l.join(r, ["volume", "offset"], "full").select("volume", "offset", status.alias("status")).where("status is not null")
