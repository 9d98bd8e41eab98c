"""Secret scans with an incremental ledger of blobs, on DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. Only pairs of a blob and a rule version that
the ledger does not hold are scanned, one copy of each, and findings are joined back to all paths with that content.

Matches come from a split by the rule's pattern: the pieces between matches and the matches themselves give all places
in code points. A failing match is dropped after the search, so it still uses up its characters.

Null texts are empty; repeated rows and ids are versions of their own; an empty table gives an empty table. Only ids,
texts and result columns are used, so extra columns cannot clash. A text is one row throughout, however long, and its
matches are rows of their own before they are gathered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, frequent, written

#: Version 1 is not used again: ledgers from before repeated rows were scanned once hold doubled spans under it.
RULES_VERSION = 2


def either_case(words: str) -> str:
    """A pattern of the words with each letter in either case: ASCII only, whatever an engine folds besides."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Fixed patterns in the order of their kinds; the number is the least length of the match, or of group 2 for assign.
#: Runs of 24 or 20 characters and more are the same matches as runs of any length with the short ones dropped.
RULES = (
    ("assign", rf"""({either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
)
KINDS = [kind for kind, _, _ in RULES]


def content(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def kind_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (rank + 1).cast("int"))


def described(rank: int, kind: str, least: int):
    """Of the i-th match of a rule: its length, that of the piece before it, and whether it is long enough."""

    def one(x: Column, i: Column) -> Column:
        judged = F.get("value", i) if kind == "assign" else x
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(F.get(f"g{rank}", i)).alias("gap"), F.length(x).alias("size"), (F.length(judged) >= least).alias("ok"))

    return one


def scan(blobs: DataFrame) -> DataFrame:
    """Of rows (blob, text): rows (blob, spans array<struct<start,rank,stop>>) in order, empty where nothing is found."""
    cols, found = [F.col("blob")], []
    for rank, (kind, pattern, least) in enumerate(RULES):
        p = F.lit(pattern)
        cols += [F.regexp_extract_all("text", p, F.lit(0)).alias(f"m{rank}"), F.split("text", pattern, -1).alias(f"g{rank}")]
        if kind == "assign":
            cols.append(F.regexp_extract_all("text", p, F.lit(2)).alias("value"))
    for rank, (kind, _, least) in enumerate(RULES):
        found.append(F.transform(f"m{rank}", described(rank, kind, least)))
    each = blobs.select(*cols).select("blob", F.explode_outer(F.concat(*found)).alias("f")).select("blob", "f.*")
    # The places of one kind within one text: a running sum over that text's matches.
    placed = each.selectExpr("*", "sum(gap + size) over (partition by blob, rank order by i rows unbounded preceding) as stop").selectExpr("blob", "ok", "stop - size as start", "rank", "stop")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("start", "rank", "stop")))).alias("spans"))


def audit(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): a row (id_col, blob, spans) for each row of versions, and the ledger with what this run
    scanned added: rows (blob, rules, spans). Blobs that the given ledger holds under this rule version are not read."""
    addressed = versions.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("path"), content(text_col).alias("text"), F.sha2(content(text_col).cast("binary"), 256).alias("blob"))
    paths = written(addressed.select("id", "path", "blob"), "paths")
    # One path of each unseen blob: the text then moves by (blob, path), which no group of copies makes hot.
    sizes = written(paths.groupBy("blob").agg(F.min("path").alias("path"), F.count("*").alias("size")), "blobs")
    chosen = sizes.select("blob", "path")
    if ledger is not None:
        chosen = chosen.join(ledger.where(F.col("rules") == RULES_VERSION).select("blob"), "blob", "left_anti")
    # Rows that repeat an id and a text, or that have none, share a path and are as many copies: one of them is scanned.
    unseen = addressed.select("blob", "path", "text").join(chosen, ["blob", "path"], "left_semi").dropDuplicates(["blob", "path"]).select("blob", "text")
    scanned = scan(unseen)
    new = written(scanned.select("blob", F.lit(RULES_VERSION).alias("rules"), "spans"), "ledger")
    now = new if ledger is None else new.unionByName(ledger.select("blob", "rules", "spans"))
    current = now.where(F.col("rules") == RULES_VERSION).select("blob", "spans")
    hot = frequent(sizes.select("blob", "size"), paths.count())
    return dealt_join(paths.drop("path"), current, ["blob"], hot).select(F.col("id").alias(id_col), "blob", "spans"), now


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [SECRET]; overlapping spans are one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("[SECRET]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), piece.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
