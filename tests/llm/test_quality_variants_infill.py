"""Quality votes, spelling variants and fill-in-middle against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import infill, quality, variants
from fieldloom.llm import queries as llm

SCHEMA = "doc_id long, text string, score string, _said string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "kept", "kept", "gone") for r in rows], SCHEMA).repartition(3)


# Fill-in-middle


def brute_cut(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return i, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    return i, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def infill_rows():
    r = random.Random(3)
    line = lambda: "".join(r.choice("ab é東\U0001f600<PSM>") for _ in range(r.randrange(6)))
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "a\rb c\n\nd", "has <S> in it\nx", "ends <", "<P", "P>\nx", "é" * 5000 + "\n" + "y" * 5000]
    texts += ["\n".join(line() for _ in range(r.randrange(1, 400))) for _ in range(60)] + ["ab\n" * 200_000]
    rows = list(enumerate(texts))
    return [*rows, rows[20], (20, "other text\nof the id"), (None, "no id\nat all\n"), (None, None), (-5, "x\ny\nz")]


def test_infill_matches_brute_force_and_is_undone(spark):
    rows = infill_rows()
    out = infill.fill_in_middle(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "score", "_said", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got) == Counter(brute_cut(*r) for r in rows)
    assert all(x.back == (x.text or "") and x._said == "kept" for x in got) and {x.form for x in got} == {"plain", "spm", "psm"}
    empty = infill.fill_in_middle(frame(spark, rows).where("false"))
    assert empty.count() == 0 and empty.columns == out.columns


def test_infill_rates(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    share = lambda **kw: Counter(x.form for x in infill.fill_in_middle(df, **kw).collect())
    assert share(rate=0) == {"plain": 400} and set(share(spm=100)) == {"spm"} and set(share(spm=0)) == {"psm"}
    assert 130 < share(rate=50)["plain"] < 270


@given(st.lists(st.sampled_from(["a", "é", "東", "\n", "\n\n"]), max_size=60), st.integers(1, 9), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_checkpoints_find_every_cut(parts, step, segment):
    text = "".join(parts)
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    held, infill.SEGMENT = infill.SEGMENT, segment
    try:
        index = infill.Checkpoints(text.encode(), step)
    finally:
        infill.SEGMENT = held
    assert index.n == len(units) and index.units == list(range(0, text.count("\n") + 1, step))
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert index.after(k) == (len(before.encode()), len(before))


# Spelling variants


def brute_words(rows):
    low, counts = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n, times=2):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(x, key=lambda v: (-n[v], v)) if (x := near[w]) else None for w in n}
    form = {w: f if f is not None and n[f] >= times * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelling_rows():
    r = random.Random(2)
    base = ["niña" + "ÀÉ", "straße", "letter", "better", "bitter", "aaaaaa", "aaaaa", "aaaaaaa", "bookkeeper", "Ünder", "ünder"]
    words = base + ["".join(r.choice("abé") for _ in range(r.choice((5, 6)))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(words) if r.random() < 0.9 else r.choice(base) for _ in range(60)) + "-Letter_1 × ÷") for i in range(80)]
    return [*rows, rows[0], (None, "letter letter bitter"), (3, None), (4, ""), (5, "12 !? 東京"), (6, "lettér " * 3000)]


def test_variants_match_brute_force(spark):
    rows = spelling_rows()
    words = variants.word_counts(frame(spark, rows), change=variants.thinned(97))
    want = brute_words(rows)
    assert {x.word: x.n for x in words.collect()} == want and len(want) > 60
    assert {tuple(x) for x in variants.variants(words).collect()} == brute_variants(want)
    none = variants.variants(variants.word_counts(frame(spark, rows).where("false")))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_with_ties_chains_and_indels(spark):
    n = {"abcde": 4, "abcdef": 9, "abcdefg": 20, "abcdefgh": 41, "abxdef": 9, "abcdeg": 9, "zzzzz": 3, "zzzzzz": 6, "zzzzzzz": 6, "qqqqq": 5, "qqqqé": 12, "qqqqa": 12}
    got = {tuple(x) for x in variants.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == brute_variants(n)
    assert next(x for x in got if x[0] == "abcde")[2] == "abcdefgh" and next(x for x in got if x[0] == "qqqqq")[1] == "qqqqa"
    with pytest.raises(ValueError):
        variants.variants(spark.createDataFrame([("abcde", 1)], "word string, n long"), times=1)


def test_variants_list_no_pairs(spark, monkeypatch):
    """All words of one pattern are near each other; what is stored has a row for each word."""
    words = spark.createDataFrame([("abc" + x + "e", 3 + k) for k, x in enumerate("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")], "word string, n long")
    held, counted = variants.written, {}
    monkeypatch.setattr(variants, "written", lambda df, name: counted.setdefault(name, held(df, name)))
    got = variants.variants(words).collect()
    assert all(x.n_near == len(got) - 1 for x in got) and all(df.count() <= len(got) for df in counted.values())


# Quality


def brute_counts(text):
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\v\f\r" else 5 if b > 127 else 0
    runs, classes, again, seen = Counter(), Counter(), Counter(), Counter()
    for k in range(len(data) - 2):
        runs[((int.from_bytes(data[k : k + 3], "big") * 0x9E3779B1) % (1 << 32)) >> 20] += 1
    for k in range(len(data) - 3):
        a, b, c, d = map(kind, data[k : k + 4])
        classes[((a * 6 + b) * 6 + c) * 6 + d] += 1
    for w in words:
        again[(seen[w] + 1).bit_length() - 1] += 1
        seen[w] += 1
    return len(words), seen, runs, classes, again


def test_terms_match_brute_force():
    texts = [None, "", "  ", "a", "ab cd", "The THE the the the the", "é" * 9, "x1! " * 70, "東京 tower 12 \x1c\x00 \n y"]
    got = quality.counts(pa.array(texts))
    w, r, c = quality.WORDS, quality.WORDS + quality.RUNS, quality.WORDS + quality.RUNS + quality.CLASSES
    for row, text in zip(got, texts):
        n, seen, runs, classes, again = brute_counts(text)
        assert row[:w].sum() == n and sorted(row[:w][row[:w] > 0]) == sorted(seen.values()) or len(seen) > 40
        assert {k: v for k, v in enumerate(row[w:r]) if v} == runs and {k: v for k, v in enumerate(row[r:c]) if v} == classes
        assert {k: v for k, v in enumerate(row[c:]) if v} == again


def test_votes_match_brute_force():
    r = np.random.default_rng(4)
    model = {"target": r.integers(0, 2, 40).astype(float), "vectors": quality.unit(r.normal(size=(40, 6)))}
    x = np.concatenate([quality.unit(r.normal(size=(30, 6))), np.zeros((1, 6))])
    for got, v in zip(quality.votes(x, model, neighbours=7, power=3), x):
        near = sorted(((float(v @ u), t) for u, t in zip(model["vectors"], model["target"])), reverse=True)[:7]
        weight = [max(0.0, c) ** 3 for c, _ in near]
        assert abs(got - (sum(a * t for a, (_, t) in zip(weight, near)) / sum(weight) if sum(weight) else model["target"].mean())) < 1e-6


def test_directions_are_singular_vectors():
    x = np.random.default_rng(5).normal(size=(60, 90)).astype(np.float32) * np.linspace(3, 0.1, 90).astype(np.float32)
    exact = np.linalg.svd(x)[2][:3]
    assert np.allclose(np.abs(np.diag(exact @ quality.directions(x, 3))), 1, atol=0.01)
    assert quality.directions(x[:2], 5).shape == (90, 2)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = llm.queries()["op11_nearest_votes"](spark, d)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    held = [x for x in rows if x.held_out]
    good, bad = [x.score for x in held if x.quality == 1], [x.score for x in held if x.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9 and np.mean([x.predicted == x.quality for x in held]) > 0.93


def test_quality_edges(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    rows = [(i, " ".join(word() + ("***" if i % 2 else "") for _ in range(20))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n"), (63, "a"), (64, "word*** " * 30000), rows[1], rows[2], (None, "no id here"), (None, None)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(5, None), (7, 3), (None, 1), (999, 1), (60, 1), (61, 0)], "doc_id long, quality int")
    df = frame(spark, rows)
    model = quality.train(df, labels)
    assert set(model["target"]) == {0.0, 1.0} and len(model["target"]) < 60 and len(model["vectors"]) == len(model["target"])
    out = quality.scored(df, model)
    assert out.columns == ["doc_id", "text", "_said", "n", "score", "predicted"]
    got = {(x.doc_id, x.text): x for x in out.collect()}
    assert out.count() == len(rows) and all(x.predicted == 1 - i % 2 for (i, _), x in got.items() if i is not None and i < 60)
    mean = float(np.mean(model["target"]))
    assert all(abs(got[k].score - mean) < 1e-9 for k in ((60, None), (61, ""), (62, " \n"), (None, None))) and got[64, "word*** " * 30000].predicted == 0
    few = quality.train(df, labels, sample=9)
    assert len(few["target"]) <= 9 and quality.scored(df, few).count() == len(rows)
    untrained = quality.train(df, labels.where("false"))
    assert {x.score for x in quality.scored(df, untrained).collect()} == {0.5} and quality.scored(df.where("false"), model).count() == 0
    assert not len(quality.train(df.where("false"), labels)["target"])


def test_labels_of_held_out_rows_are_never_learned(spark):
    rows = [(i, f"text {i} of {i % 7}") for i in range(90)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((x.doc_id, x.score) for x in quality.scored(df, quality.train(df, y)).collect()) for y in (labels, turned))
    assert a == b
