"""Text functions on every code point against the rules of Unicode as Python has them."""

import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text as X


def bare(s):
    return "".join(p for p in unicodedata.normalize("NFD", s) if unicodedata.category(p) != "Mn")


@pytest.mark.parametrize("f, rule", [(X.strip_accents, bare), (X.case_fold, str.casefold)])
def test_every_code_point(spark, f, rule):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(f"{chr(c)}|" for c in codes[k : k + 500]),) for k in range(0, len(codes), 500)]
    df = spark.createDataFrame(rows, "s string").repartition(8)
    wrong = [(hex(ord(a)), b, rule(a)) for r in df.select("s", f(F.col("s")).alias("t")).collect() for a, b in zip(r.s.split("|"), r.t.split("|")) if "|" not in (a, b) and b != rule(a) and a and unicodedata.category(a) not in ("Cn", "Mn")]
    assert not wrong, wrong[:20]


def test_words(spark):
    pairs = [("Straße", "STRASSE"), ("ΣΊΣΥΦΟΣ", "σίσυφος"), ("ﬁn", "FIN"), ("İ", "i̇"), ("ǅ", "ǆ")]
    rows = spark.createDataFrame(pairs, "a string, b string").select((X.case_fold(F.col("a")) == X.case_fold(F.col("b"))).alias("same"), X.case_fold(F.col("a")).alias("t"), "a").collect()
    assert all(r.same and r.t == r.a.casefold() for r in rows)
    rows = spark.createDataFrame([("각 가 e\u0301 Ǻ",), (None,), ("",)], "s string").select(X.strip_accents(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows] == [bare("각 가 e\u0301 Ǻ"), None, ""]


def test_texts_without_such_letters_are_not_taken_apart(spark):
    plan = spark.createDataFrame([("a",)], "s string").select(X.case_fold(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE(s" in plan


@pytest.mark.parametrize("path", ["a/b.c/d", "dir.v1/name", "a..b", "..ab.c", "..b", ".b", "x.tar.gz", "a/.hidden", "a/b.", "", "/", "a.b/c.d.e"])
def test_stems(spark, path):
    assert spark.createDataFrame([(path,)], "s string").select(X.file_stem(F.col("s")).alias("t")).first().t == os.path.splitext(path)[0]
