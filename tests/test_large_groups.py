"""Operators for very large groups against brute force: similar texts, islands in ranges, tiled joins, exact medians."""

import math
import random
from difflib import SequenceMatcher
from statistics import median

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.text import plate_confusables
from fieldloom.operators import aggregates, joins, similar, windows


def both_ratios(a, b):
    return SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()


@pytest.mark.parametrize("least, longest", [(0.85, 9), (0.85, 24), (0.7, 8)])
def test_similar_pairs_match_brute_force(spark, least, longest):
    r = random.Random(longest)
    base = ["".join(r.choice("AB01") for _ in range(r.randrange(1, longest + 1))) for _ in range(70)]

    def edited(x):
        for _ in range(r.randrange(3)):
            k = r.randrange(len(x) + 1)
            x = r.choice((x[:k] + r.choice("AB01Z") + x[k:], x[:k] + x[k + 1 :], x[: max(0, k - 1)] + r.choice("AB01Z") + x[k:]))
        return x

    left, right = [*base, base[0], "", None], [*(edited(x) for x in base), *(edited(x) for x in base), None, ""]
    frames = [spark.createDataFrame([(x,) for x in xs], f"{n} string") for n, xs in (("a", left), ("b", right))]
    got = {(x.a, x.b): (x.forth, x.back) for x in similar.similar_pairs(*frames, "a", "b", least).collect()}
    want = {(a, b): both_ratios(a, b) for a in set(left) - {None, ""} for b in set(right) - {None, ""}}
    assert got == {k: v for k, v in want.items() if max(v) >= least} and len(got) > 50


def test_similar_pairs_of_plates_by_both_keys(spark):
    """Texts whose deletions are too many meet by segments; plates are folded before."""
    long = "ABCDEFGHJKMNPRTUVWXY2345679"
    a = spark.createDataFrame([(long,), ("A0A952",), ("B1C234",)], "p string").select(plate_confusables(F.col("p")).alias("a"))
    b = spark.createDataFrame([(long[:5] + long[9:],), ("A" + long + "Q",), ("AOA952",), ("AOA95",), ("A0A9527",), ("A0A851",)], "p string").select(plate_confusables(F.col("p")).alias("b"))
    got = {(x.a, x.b) for x in similar.similar_pairs(a, b, "a", "b").collect()}
    fold = lambda s: s.translate(str.maketrans("ODQILSZB", "00011528"))
    assert got == {(fold(long), fold(long[:5] + long[9:])), (fold(long), fold("A" + long + "Q"))} | {("A0A952", x) for x in ("A0A952", "A0A95", "A0A9527")}


def test_either_order_of_a_pair_counts(spark):
    a, b = spark.createDataFrame([("tide",), ("diet",)], "a string"), spark.createDataFrame([("diet",), ("tide",)], "b string")
    got = {(x.a, x.b): (x.forth, x.back) for x in similar.similar_pairs(a, b, "a", "b", 0.45).collect()}
    assert got == {("tide", "tide"): (1, 1), ("diet", "diet"): (1, 1), ("tide", "diet"): both_ratios("tide", "diet"), ("diet", "tide"): both_ratios("diet", "tide")}
    assert got["tide", "diet"][0] != got["tide", "diet"][1]


def test_few_pairs_are_tried(spark):
    """Plates that share a letter or two are not compared."""
    r = random.Random(1)
    plates = ["".join(r.choice("ACEFGHJKMN1234567") for _ in range(6)) for _ in range(2000)]
    df = spark.createDataFrame([(p,) for p in plates], "a string")
    assert similar.candidates(df, df.withColumnRenamed("a", "b"), "a", "b").count() < 3 * len(plates)


def test_dealt_pairs_is_the_join(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", "x", "x", "y", f"k{r.randrange(40)}", None]), k) for k in range(600)]
    left, right = spark.createDataFrame(rows, "key string, a int"), spark.createDataFrame(rows[:200], "key string, b int")
    want = sorted((x[0], x[1], y[1]) for x in rows for y in rows[:200] if x[0] is not None and x[0] == y[0])
    for few in (20, 10**6):
        assert sorted(map(tuple, joins.dealt_pairs(left, right, "key", few).select("key", "a", "b").collect())) == want


def island_rows(n=3000):
    r = random.Random(3)
    rows = [("big", float(v), k) for k, v in enumerate(sorted(r.choice((r.randrange(100_000), r.randrange(300))) for _ in range(n)))]
    rows += [(f"k{i % 7}", float(r.randrange(500)), 10_000 + i) for i in range(200)]
    return [*rows, ("big", None, 20_000), ("big", None, 20_001), (None, 1.0, 20_002), (None, 90.0, 20_003), ("one", 5.0, 20_004)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_islands_in_ranges_are_the_islands(spark, inclusive):
    df = spark.createDataFrame(island_rows(), "k string, v double, i int").repartition(5)
    args = ["k"], "v", ["v", "i"], F.lit(25.0), "island"
    want = sorted(map(tuple, windows.gap_islands(df, *args, inclusive).select("k", "v", "i", "island").collect()), key=repr)
    got = windows.ranged_islands(df, *args, inclusive, ranges=16)
    assert got.columns == ["k", "v", "i", "island"] and sorted(map(tuple, got.collect()), key=repr) == want
    assert len({x[3] for x in want if x[0] == "big"}) > 100
    assert windows.ranged_islands(df.where("false"), *args).count() == 0


def test_walk_back_in_ranges(spark):
    rows = [(k, float(x), float(x + w)) for k, xs in (("a", [0, 10, 60, 70, 80, 500]), ("b", range(0, 4000, 9)), ("c", [7])) for x, w in ((x, 6) for x in xs)]
    df = spark.createDataFrame(rows, "k string, x double, r double")
    args = ["k"], [F.desc("x")], "x", "r", F.lit(30.0)
    want = sorted(map(tuple, windows.walk_back(df, *args).collect()))
    assert sorted(map(tuple, windows.ranged_walk_back(df, *args, ranges=16).collect())) == want and len(want) == 1 + 445 + 1


def test_no_range_has_a_large_share(spark, monkeypatch):
    sizes, held = [], windows.stored

    def seen(df, name):
        out = held(df, name)
        if "_range" in out.columns and "v" in out.columns:
            sizes.extend(x["count"] for x in out.groupBy("k", "_range").count().collect())
        return out

    monkeypatch.setattr(windows, "stored", seen)
    df = spark.range(40_000).select(F.lit("one").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("v"), "id")
    got = windows.ranged_islands(df, ["k"], "v", ["v", "id"], F.lit(1000.0), "island", ranges=20)
    assert got.agg(F.max("island")).first()[0] == 39_999 - 500 and max(sizes) < 40_000 / 20 * 2.5


def overlap(a, b):
    return a[0] == b[0] and None not in (*a[1:3], *b[1:3]) and a[2] >= b[1] and a[1] < b[2]


def test_tiled_overlap_matches_brute_force(spark):
    r = random.Random(4)
    size = lambda: r.choice((0.0, 0.5, 3.0, 3.0, 40.0, 1000.0, 4096.0))
    make = lambda n: [(r.choice("xyz"), round(r.uniform(-500, 3000), 1), k) for k in range(n)]
    left = [(k, b, b + size(), i) for k, b, i in make(300)] + [("x", None, 1.0, 900), ("x", 3.0, None, 901), (None, 1.0, 2.0, 902), ("x", 5.0, 4.0, 903)]
    right = [(k, b, b + size(), i) for k, b, i in make(300)] + [("x", -1e6, 1e6, 910), ("x", 2.0, 2.0, 911), (None, 0.0, 9.0, 912), ("y", 7.0, 1.0, 913)]
    a, b = spark.createDataFrame(left, "k string, begin double, end double, i int"), spark.createDataFrame(right, "k string, low double, high double, j int")
    sound = lambda x: None not in x[1:3] and x[1] <= x[2]
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] is not None and sound(x) and sound(y) and overlap(x, y))
    got = joins.tiled_overlap(a, b, ["k"], "begin", "end", "low", "high")
    assert got.columns == ["k", "begin", "end", "i", "low", "high", "j"] and sorted((x.i, x.j) for x in got.collect()) == want and len(want) > 1000
    plain = joins.interval_overlap(a.where("begin <= end"), b.where("low <= high"), ["k"], "begin", "end", "low", "high")
    assert sorted((x.i, x.j) for x in plain.collect()) == want
    assert joins.tiled_overlap(a, b.where("false"), ["k"], "begin", "end", "low", "high").count() == 0


def test_tiled_boxes_match_brute_force(spark):
    r = random.Random(5)
    points = [(r.choice("xy"), r.uniform(-50, 50), float(r.randrange(100)), k) for k in range(500)] + [("x", None, 1.0, 900), (None, 1.0, 1.0, 901)]
    corner = lambda: (r.uniform(-60, 50), float(r.randrange(100)))
    boxes = [(r.choice("xy"), x, x + r.choice((0.0, 1.0, 30.0, 200.0)), y, y + r.choice((0.0, 2.0, 50.0)), k) for k, (x, y) in enumerate(corner() for _ in range(200))]
    boxes += [("x", -1e9, 1e9, -5.0, 200.0, 910), ("x", 1.0, 0.0, 0.0, 9.0, 911), ("y", 0.0, None, 0.0, 9.0, 912)]
    p, b = spark.createDataFrame(points, "k string, x double, y double, i int"), spark.createDataFrame(boxes, "k string, x0 double, x1 double, y0 double, y1 double, j int")
    axes = [("x", "x0", "x1"), ("y", "y0", "y1")]
    inside = lambda q, c: q[0] == c[0] and q[0] and None not in (*q[1:3], *c[1:5]) and c[1] <= q[1] <= c[2] and c[3] <= q[2] <= c[4]
    want = sorted((q[3], c[5]) for q in points for c in boxes if inside(q, c))
    got = joins.tiled_contained(p, b, ["k"], axes)
    assert sorted((x.i, x.j) for x in got.collect()) == want and len(want) > 1000
    assert sorted((x.i, x.j) for x in joins.contained(p, b, ["k"], axes).collect()) == want
    assert joins.tiled_contained(p, b.where("false"), ["k"], axes).count() == 0


def test_tiles_join_in_proportion_to_the_results(spark):
    """Short intervals of one key along a line, and one that spans it all: no pair is tried that is far apart."""
    a = spark.range(20_000).select(F.lit("x").alias("k"), (F.col("id") * 10.0).alias("begin"), (F.col("id") * 10.0 + 4).alias("end"))
    b = spark.range(20_000).select(F.lit("x").alias("k"), (F.col("id") * 10.0 + 3).alias("low"), (F.col("id") * 10.0 + 9).alias("high"))
    b = b.unionByName(spark.createDataFrame([("x", 0.0, 200_000.0)], b.schema))
    tried = joins.tiled_pairs(a, b, ["k"], "begin", "end", "low", "high").count()
    assert joins.tiled_overlap(a, b, ["k"], "begin", "end", "low", "high").count() == 40_000 and tried < 4 * 40_000


@pytest.mark.parametrize("few", [1, 50, 10**6])
def test_exact_medians_of_large_groups(spark, few):
    r = random.Random(6)
    groups = {
        "even": [r.uniform(-1e3, 1e3) for _ in range(400)], "odd": [float(r.randrange(40)) for _ in range(401)], "ties": [5.0] * 300 + [7.0] * 300, "one": [3.25], "two": [1.0, -1.0],
        "wide": [math.copysign(10.0 ** r.uniform(-300, 300), r.random() - 0.5) for _ in range(500)], "near": [1 + k * 2**-52 for k in range(300)], "far": [-1.7e308, 1.7e308, 0.0], None: [1.0, 2.0, 9.0, 9.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None), ("nothing", None), ("odd", float("nan"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: x.m for x in aggregates.exact_medians(df, ["k"], "v", "m", steps=8, few=few).collect()}
    assert set(got) == {*groups, "nothing"} and got.pop("nothing") is None
    want = {k: median(v) for k, v in groups.items()}
    assert all(got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-15) for k in want)
    assert aggregates.exact_medians(df.where("false"), ["k"], "v", "m").count() == 0


def test_histograms_stay_small(spark, monkeypatch):
    sizes, held = [], aggregates.stored
    monkeypatch.setattr(aggregates, "stored", lambda df, name: sizes.append((out := held(df, name)).count()) or out)
    df = spark.range(100_000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    got = {x.k: x.m for x in aggregates.exact_medians(df, ["k"], "v", "m", steps=100, few=100).collect()}
    assert got == {x.k: x.m for x in df.groupBy("k").agg(F.median("v").alias("m")).collect()} and max(sizes) <= 3 * 2 and len(sizes) <= 10


def test_totals_of_overlaps_match_brute_force(spark):
    r = random.Random(8)
    number = lambda: r.choice((float(r.randrange(12)), r.random() * 12))
    left = [(k, r.choice("AB"), (x := number()), x + r.choice((0.0, 1.0, 5.0))) for k in range(60)] + [(98, "A", 5.0, 1.0), (99, "C", 1.0, 2.0), (97, "A", None, 1.0)]
    right = [(r.choice("AB"), (x := number()), x + r.choice((0.0, 0.5, 2.0, 9.0)), r.randrange(-5, 9)) for _ in range(90)] + [("A", 9.0, 2.0, 1), (None, 1.0, 2.0, 1)]
    a, b = spark.createDataFrame(left, "id int, k string, x double, y double"), spark.createDataFrame(right, "k string, low double, high double, v int")
    both = joins.overlap_totals(a, b, ["k"], "x", "y", "low", "high", {"n": F.lit(1), "v": F.col("v")})
    got = {x.id: (x.n, x.v) for x in both.groupBy("id").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    want = {}
    for i, k, x, y in left:
        if x is not None and x <= y:
            met = [v for j, low, high, v in right if j == k and low <= high and y >= low and x < high]
            want[i] = (len(met), sum(met))
    assert got == want and len({n for n, _ in want.values()}) > 9
    found = joins.tiled_overlap(a, b, ["k"], "x", "y", "low", "high").groupBy("id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    assert {x.id: (x.n, x.v) for x in found.collect()} == {k: v for k, v in want.items() if v[0]}


def test_tiles_do_not_go_through_the_driver(spark):
    a, b = spark.createDataFrame([(1, 1.0, 2.0)], "k int, x double, y double"), spark.createDataFrame([(1, 0.0, 9.0)], "k int, low double, high double")
    for found in (joins.tiled_overlap(a, b, ["k"], "x", "y", "low", "high"), joins.tiled_contained(a, b, ["k"], [("x", "low", "high")])):
        assert found.count() == 1 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
