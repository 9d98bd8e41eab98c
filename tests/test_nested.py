"""Operators within a row against those over rows, and the extraction's plan: tokens are read and shuffled once."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from fieldloom.functions import text as X
from fieldloom.operators import nested, windows
from fieldloom.operators.aggregates import median
from fieldloom.plans import extract
from fieldloom.sources import synthetic as s


def test_tokens_are_read_and_shuffled_once(spark, tmp_path, monkeypatch):
    """The steps after the first work on rows that hold a page: no window over tokens, and nothing is made of them again."""
    tokens, pages = s.odd_forms(spark.range(20).withColumnRenamed("id", "k"), "k")
    tokens.write.parquet(str(tmp_path / "tokens"))
    plans, stored = [], extract.stored
    seen = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name)
    for module in (extract, extract.matching):
        monkeypatch.setattr(module, "stored", seen)
    e = extract.extract(spark.read.parquet(str(tmp_path / "tokens")), pages)
    assert e.results.count() == 240 and e.warnings.count() > 0
    assert sum(len(re.findall(r"FileScan parquet[^\n]*/tokens", p)) for p in plans) == 1
    assert not any("Window" in p for p in plans) and sum("SortMergeJoin" in p for p in plans[:4]) == 1


def test_islands_runs_and_medians_within_a_row(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.randint(0, 60), rnd.randint(1, 9)) for k in range(40) for i in range(rnd.randint(1, 15))]
    df = spark.createDataFrame(rows, "k int, i int, v int, w int")
    marked = windows.gap_islands(df, ["k"], "v", ["v", "i"], F.lit(4), "island")
    want = sorted((r.k, r.island, sorted(r.s)) for r in marked.groupBy("k", "island").agg(F.collect_list("i").alias("s")).collect())
    whole = df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("v", "i", "w"))).alias("s"))
    cut = whole.select("k", F.posexplode(nested.islands(F.col("s"), "v", F.lit(4), lambda part, _: part["i"])).alias("island", "ids"))
    assert sorted((r.k, r.island, sorted(r.ids)) for r in cut.collect()) == want

    run = windows.walk_back(df.withColumn("end", F.col("v") + F.col("w")), ["k"], [F.desc("v"), F.desc("i")], "v", "end", F.lit(3))
    want = {r.k: r.v for r in run.groupBy("k").agg(F.min("v").alias("v")).collect()}
    first = nested.last_run(F.col("s"), lambda x: x["v"], lambda x: x["v"] + x["w"], F.lit(3))
    got = whole.select("k", first["v"].alias("v"), nested.middle(F.col("s")["v"]).alias("m"), nested.average(F.col("s")["w"]).alias("a")).collect()
    means = {r.k: (r.m, r.a) for r in df.groupBy("k").agg(median("v").alias("m"), F.avg("w").alias("a")).collect()}
    assert {r.k: r.v for r in got} == want and {r.k: (r.m, r.a) for r in got} == means
    none = spark.range(1).select(F.array().cast("array<int>").alias("s"))
    assert tuple(none.select(nested.middle(F.col("s")), nested.average(F.col("s").cast("array<double>")), nested.last_run(F.col("s"), lambda x: x, lambda x: x, F.lit(1))).first()) == (None, None, None)


def test_short_rules_give_what_the_long_ones_give(spark):
    """Labels and numbers that are common go by a shorter way to the same result."""
    bare = lambda t: "".join(p for p in unicodedata.normalize("NFD", t) if unicodedata.category(p) != "Mn")
    texts = [chr(c) for c in (*range(1, 0x250), 0x212A, 0x2014, 0xAC00)] + ["N°", "Características:", "ÁÉ-1", "İx", "Kelvin K", "각a", "", "áb"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", X.label_token(F.col("s")).alias("t")).collect()
    assert [(r.s, r.t) for r in got if r.t != re.sub("[^a-z0-9]", "", bare(r.s).lower())] == []
    numbers = {"0": ("0", "0"), "07": ("7", "7"), "+7": ("7", "7"), ": 12": ("12", "12"), "1.50": (None, "1.50"), "00.5": (None, "0.5"), "1,5": (None, "1.5"), "1\n": ("1", "1"), "1 2": ("12", "12"), " -—5": ("5", "5"), "x": (None, None), "٣": (None, None)}
    rows = spark.createDataFrame([(t,) for t in numbers], "s string").select("s", X.int_text(F.col("s")).alias("i"), X.decimal_text(F.col("s")).alias("d")).collect()
    assert {r.s: (r.i, r.d) for r in rows} == numbers
    spaces = [chr(c) for c in range(1, 0x3001) if not 0xD800 <= c < 0xE000]
    kept = spark.createDataFrame([(c,) for c in spaces], "s string").where(X.trim_spaces(F.col("s")) != F.regexp_replace("s", r"(?U)^\s+|\s+\z", "")).count()
    assert kept == 0


def test_words_of_a_cell_are_placed_by_what_is_passed(spark):
    cells = spark.createDataFrame([("d", 0, 1, "Tipo  de Uso ", "a bc d", False, 90.0, None), ("d", 1, 2, "x", "1 2", True, 90.0, "y z")], s.CELLS)
    got = {(r.text, r.ord): r.x for r in s.laid_out(cells, False).collect()}
    left, colon, value = s.PLACES[0]
    want = {("Tipo", 100): left, ("de", 101): left + 4 * s.GLYPH + s.SPACE, ("Uso", 102): left + 6 * s.GLYPH + 2 * s.SPACE, (":", 120): colon, ("a", 130): value, ("bc", 131): value + s.GLYPH + s.SPACE, ("d", 132): value + 3 * s.GLYPH + 2 * s.SPACE}
    assert got == want | {("y z", 1200): s.PLACES[1][1] - 24 - 3 * s.GLYPH, ("81 2", 1220): s.PLACES[1][1]}
