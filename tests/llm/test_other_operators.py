"""Media, archives and vectors against brute force, with nulls, repeated rows and empty tables."""

import io
import random
import wave

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import common, lattice, media, queries, warc


def tune(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_audio_search_finds_shifted_and_noisy_recordings(spark):
    r = random.Random(3)
    a, b = tune(r, 80), tune(r, 80)
    noisy = a.split()
    noisy[40] = "other"
    rows = [(100, 0, a), (1, 0, " ".join(a.split()[20:])), (2, 0, " ".join(noisy)), (3, 0, b), (4, 0, a), (5, 0, None), (6, 0, ""), (200, 0, tune(r, 5)), (None, 1, b)]
    made = media.sonified(spark.createDataFrame(rows, "conv_id long, turn long, text string"), ["conv_id", "turn"])
    members, matches = media.search(made, F.col("conv_id") % 100 == 0, ["conv_id", "turn"])
    classes = {(x.conv_id, x.turn): (x["class"].conv_id, x.copies) for x in members.collect()}
    assert classes == {(100, 0): (4, 1), (4, 0): (4, 1), (1, 0): (1, 0), (2, 0): (2, 0), (3, 0): (None, 1), (None, 1): (None, 1), (200, 0): (200, 0)}
    got = {(x["class"].conv_id, x.match.conv_id): x for x in matches.collect()}
    assert set(got) == {(4, 1), (4, 2)}
    assert got[4, 1].offset == 20 and got[4, 1].bit_errors < 0.01 and got[4, 2].offset == 0 and 0 < got[4, 2].bit_errors < 0.2
    empty = media.search(made.where("turn < 0"), F.lit(True), ["conv_id", "turn"])
    assert [x.count() for x in empty] == [0, 0]


def test_audio_query_has_a_row_per_recording(spark, tmp_path):
    r = random.Random(6)
    a, b, c = tune(r, 60), tune(r, 60), tune(r, 60)
    rows = [(100, 0, a), (1, 0, " ".join(a.split()[10:])), (2, 0, a), (2, 0, a), (3, 0, b), (200, 1, b), (7, 0, None), (None, 1, c), (300, 1, c), (9, 1, " ".join(c.split()[5:]))]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(x)[:8] for x in queries.op6_audio_fingerprints(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(100, 0, 2, 0, 2, None, None, None), (1, 0, 1, 0, 0, None, None, None), *[(2, 0, 2, 0, 2, 1, 0, 10)] * 2, (3, 0, 3, 0, 1, None, None, None), (200, 1, 3, 0, 1, None, None, None), (None, 1, None, 1, 1, 9, 1, 5), (300, 1, None, 1, 1, None, None, None), (9, 1, 9, 1, 0, None, None, None)], key=str)


def test_audio_search_finds_near_copies_of_short_recordings(spark):
    r = random.Random(11)
    tunes = {w: tune(r, w) for w in (5, 19, 20, 21, 22, 23, 25)}
    wav = {x.id: bytes(x.audio) for x in media.sonified(spark.createDataFrame(list(tunes.items()), "id long, text string"), ["id"]).collect()}
    long = media.sonified(spark.createDataFrame([(1, " ".join([tune(r, 30), tunes[21], tune(r, 30)]))], "id long, text string"), ["id"]).first().audio
    # One sample changed by one: other bytes, the same sound. A last note that is lost changes some of the integers.
    near = {w: v[:-600] + bytes([v[-600] ^ 1]) + v[-599:] for w, v in wav.items()}
    rows = [(100 * w, wav[w]) for w in wav] + [(100 * w + 1, near[w]) for w in wav] + [(1, bytes(long))]
    rows += [(100 * w + 2, media_without_last(wav[w])) for w in (21, 23, 25)]
    _, matches = media.search(spark.createDataFrame(rows, "id long, audio binary"), F.col("id") % 100 == 0, ["id"])
    got = {(x["class"].id, x.match.id): x for x in matches.collect()}
    assert {(100 * w, 100 * w + 1) for w in wav} <= set(got)
    assert got[2100, 1].offset == -30 and got[2100, 1].overlap == 3
    assert {(100 * w, 100 * w + 2) for w in (21, 23, 25)} <= set(got)
    assert all(a // 100 == b // 100 or (a, b) == (2100, 1) for a, b in got)


def media_without_last(data):
    """A recording with its last note silent."""
    x, rate = media.samples_of(data)
    x[-media.HOP :] = 0
    with wave.open(held := io.BytesIO(), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(x.astype("<i2").tobytes())
    return held.getvalue()


def test_unreadable_audio_has_no_fingerprint(spark):
    df = spark.createDataFrame([(1, b"no wav"), (2, None), (3, b"")], "id long, audio binary")
    assert media.fingerprints(df, ["id"]).count() == 0


def wav(samples, rate, channels=1):
    with wave.open(held := io.BytesIO(), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.asarray(samples).astype("<i2").tobytes())
    return held.getvalue()


def test_audio_search_against_brute_force(spark):
    r, rows = random.Random(21), []
    for k in range(40):
        words = tune(r, r.randrange(25, 90)).split()
        rows.append((100 * k, " ".join(words)))
        for j in range(1, 4):  # cut at either end, with 3 or 6 % of the words changed
            near = words[r.randrange(8) : len(words) - r.randrange(8)]
            near = [f"n{r.random()}" if r.random() < 0.03 * (j - 1) else w for w in near]
            rows.append((100 * k + j, " ".join(near)))
    made = {x.id: bytes(x.audio) for x in media.sonified(spark.createDataFrame(rows, "id long, text string"), ["id"]).collect()}
    df = spark.createDataFrame(list(made.items()), "id long, audio binary")
    _, matches = media.search(df, F.col("id") % 100 == 0, ["id"])
    got = {(x["class"].id, x.match.id): x for x in matches.collect()}
    prints = {i: media.fingerprint(*media.samples_of(a)).view(np.uint32) for i, a in made.items()}

    def errors(x, y, o):
        n = min(len(x), len(y) + o) - max(o, 0)
        a, b = x[max(o, 0) : max(o, 0) + n], y[max(-o, 0) : max(-o, 0) + n]
        return np.bitwise_count(a ^ b).sum() / (32 * n), n

    close = set()
    for q in (i for i in prints if i % 100 == 0):
        for i, y in prints.items():
            x = prints[q]
            if i != q and made[i] != made[q] and any(e <= 0.15 and n >= 8 and 2 * n >= min(len(x), len(y)) for e, n in (errors(x, y, o) for o in range(4 - len(y), len(x) - 3))):
                close.add((q, i))
    assert len(close) >= 50 and len(close & set(got)) >= 0.9 * len(close)
    for (q, i), m in got.items():
        e, n = errors(prints[q], prints[i], m.offset)
        assert abs(e - m.bit_errors) < 1e-9 and n == m.overlap and e <= media.BIT_ERRORS


def test_audio_of_other_rates_and_broken_headers(spark):
    r = random.Random(22)
    words = tune(r, 60)
    a = bytes(media.sonified(spark.createDataFrame([(1, words)], "id long, text string"), ["id"]).first().audio)
    x = media.samples_of(a)[0]
    double = np.interp(np.arange(2 * len(x)) / 2, np.arange(len(x)), x)
    no_rate = a[:24] + bytes(4) + a[28:]
    rows = [(100, a, "s"), (1, wav(double, 8000), "s"), (2, wav(np.repeat(x, 2), 4000, 2), "s"), (3, no_rate, "s"), (4, a[:30], "s"), (5, a[:22] + bytes(2) + a[24:], "s"), (6, wav([], 4000), "s"), (7, wav(np.zeros(5000), 4000), "s"), (8, None, "s")]
    df = spark.createDataFrame(rows, "id long, audio binary, sha string")
    assert sorted(x.id for x in media.fingerprints(df, ["id"]).collect()) == [1, 2, 100]
    _, matches = media.search(df, F.col("id") % 100 == 0, ["id"])
    assert {x.match.id for x in matches.collect()} == {1, 2}


def test_archives_of_rows_without_ids_and_damaged_bytes(spark):
    rows = [(i, f"u{i}", "body" * i, 1, "x") for i in range(40)] + [(None, None, str(i), 1, "x") for i in range(2500)] + [(None, None, "0", 1, "x"), (3, None, None, 2, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, volume int, sha256 string")
    both = common.written(warc.archive(df, copy=F.overlay("record", F.lit("w"), F.lit(1)), lost=F.coalesce(F.col("id") == 5, F.lit(False))), "both")
    assert both.count() == len(rows) and both.groupBy("volume", "offset").count().where("count > 1").count() == 0
    assert both.where("volume < 0").select("volume").distinct().count() == 3
    assert both.where("copy_sha256 = sha256 or copy_length <> length").count() == 0 and [x.id for x in both.where("lost").collect()] == [5]
    text = spark.createDataFrame([("http://x", "abc")], "u string, b string").select(warc.record(F.col("u"), F.col("b")).alias("r")).first().r
    head, body = text.split("\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    assert body == "abc\r\n\r\n" and list(fields) == ["WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"] and len(fields["WARC-Record-ID"]) == 47


def test_merkle_audit_locates_damage(spark):
    r = random.Random(4)
    rows = [(i, f"http://x/{i}", tune(r, 300)) for i in range(2500)] + [(None, None, "lost id"), (7, "http://x/7", "again"), (8, None, None)]
    manifest = common.written(warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")), "manifest")
    bad, gone = F.col("offset") % 97 == 5, F.col("offset") % 101 == 7
    extra = manifest.where(gone).limit(1).select("volume", (F.col("offset") + 10**9).alias("offset"), "length", "sha256", "id")
    replica = common.written(manifest.where(~gone).withColumn("sha256", F.when(bad, F.lit("x")).otherwise(F.col("sha256"))).unionByName(extra), "replica")
    got = {(x.volume, x.offset): x.status for x in warc.audit(manifest, replica).collect()}
    want = {(x.volume, x.offset): "missing" if x.g else "corrupt" for x in manifest.select("volume", "offset", gone.alias("g"), bad.alias("b")).where("g or b").collect()}
    want |= {(x.volume, x.offset): "extra" for x in extra.collect()}
    assert got == want and len(want) > 20
    assert warc.audit(manifest, manifest).count() == 0 and warc.audit(manifest.limit(0), manifest.limit(0)).count() == 0


def test_lattice_matches_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 64))
    rows = [(i, [float(x) for x in centres[i % 40] + (i % 5) * 0.06 * r.standard_normal(64)], i % 2) for i in range(300)]
    rows += [(400, rows[0][1], 0), (401, None, 0), (402, [0.0] * 64, 0), (403, rows[0][1], None), (404, [float("nan")] * 64, 0), (405, [], 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1)]
    got = {x.vec_id: x for x in lattice.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ok = [(i, np.array(v), c) for i, v, c in rows if v and c is not None and np.isfinite(v).all() and np.any(v)]
    links, near = {i: set() for i, *_ in rows}, lambda x, y: len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93
    for i, x, c in ok:
        links[i] = {j for j, y, d in ok if j != i and c == d and near(x, y)}
    total = sum(map(len, links.values()))
    assert total > 200 and sum(x.n_links for x in got.values()) >= 0.97 * total and all(got[i].n_links <= len(links[i]) for i in links)
    for i in (401, 402, 403, 404, 405):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[400].component_id == 0 and got[407].component_id == 406
    assert lattice.linked(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_lattice_compares_labels_of_any_type(spark):
    v, w = [1.0, 2.0, 0.5], [1.0, 2.0, 0.51]
    for kind, labels in (("string", ["a", "a", "b", None, ""]), ("double", [1.2, 1.2, 1.7, None, 0.0]), ("array<int>", [[1], [1], [1, 1], None, []]), ("boolean", [True, True, False, None, False])):
        rows = [(i, x, c, "other", 7) for i, (x, c) in enumerate(zip([v, w, v, v, [0.0] * 3], labels))]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}, node string, cell int")
        got = {x.vec_id: (x.n_links, x.component_id) for x in lattice.linked(df).collect()}
        assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (0, 4)}
    zeros = spark.createDataFrame([(1, v, 0.0), (2, w, -0.0), (3, v, float("nan")), (4, w, float("nan"))], "vec_id long, embedding array<double>, label double")
    assert {x.vec_id: x.component_id for x in lattice.linked(zeros).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_components_of_a_star_and_of_ties(spark):
    star = spark.range(1, 30_001).selectExpr("id as a", "100000L as b")
    got = common.components(star).groupBy("component").count().collect()
    assert [(x.component, x["count"]) for x in got] == [(1, 30_001)]
    assert common.components(star.where("a < 0")).count() == 0


def test_joins_with_a_frequent_key_lose_and_repeat_nothing(spark):
    rows = common.written(spark.range(6000).selectExpr("id as v", "if(id % 3 = 0, 7, id) as k"), "rows")
    table = spark.range(6000).selectExpr("id as k", "id * 2 as w")
    want = sorted((x, 14 if x % 3 == 0 else 2 * x) for x in range(6000))
    for hot in (common.frequent(rows.groupBy("k").agg(F.count("*").alias("size")), 6000), []):
        assert sorted((x.v, x.w) for x in common.dealt_join(rows, table, ["k"], hot).collect()) == want
        assert sorted((x.v, x.w) for x in common.dealt_join(rows, table.where("k < 10"), ["k"], hot, "left").collect() if x.w is not None) == [x for x in want if x[0] % 3 == 0 or x[0] < 10]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 100), (7, 7)], "a long, b long")
    assert {x.node: x.component for x in common.components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
