"""Text functions on their cases, the queue job, sources, and every query against its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldloom import queries
from fieldloom.functions import text as X
from fieldloom.functions.similarity import plates_match
from fieldloom.operators import joins as J
from fieldloom.operators.tables import shared_folder, stored, temporary_tables
from fieldloom.sources import files, tokens
from fieldloom.streaming import queue

DATA = "/root/testdata/sf0.001"


def each(spark, f, inputs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r.v for r in df.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("f, cases", [
    (X.normalize_plate, {"2ZR-315": "2ZR315", " a0a-952 ": "A0A952"}),
    (X.decimal_text, {"2.89": "2.89", "2,89": "2.89", "4.6": "4.6", "20": "20", "": None, "abc": None, "1.2.3": None, "1,234.5": None, "##########": None, "AAAAAIAAAAAAE": None, "4-6": None, "-5": "5", ".6": "6", "2.890": "2.890"}),
    (X.int_text, {"4": "4", "20": "20", " 19 ": "19", ":6": "6", "2.5": None, "": None, "N/A": None, "##": None}),
    (X.label_token, {"Ancho": "ancho", "Categoría": "categoria"}),
    (X.is_ordinal_marker, dict.fromkeys(["N°", "Nº", "N", "N.", "Nro", "No", "N*", "N?", "N?*"], True) | dict.fromkeys(["Neto", "Nro.Serie", "Numero", "Peso", "Ejes"], False)),
    (X.strip_leading_separator, {":4.6": "4.6", " :4.6": "4.6", "; 20": "20", "|2.76": "2.76", "— 4X2": "4X2", ". 6": "6"}),
    (lambda s: X.looks_masked(s, F.lit(0.0)), {"##########": True, "AAAAAIAAAAAAE": True, "ad ddidaididid": True, "2.89": False, "": False, "interprovincial": False}),
    (X.drive_id, {"https://x/d/abcdefghij1/view": "abcdefghij1", "https://x?id=abcdefghij2&z": "abcdefghij2", "abcdefghij3": "abcdefghij3", "short": None}),
])
def test_functions(spark, f, cases):
    assert each(spark, f, list(cases)) == list(cases.values())


def test_plates(spark):
    same = ["AOA952 A0A952", "A0OL952 A0L952", "AO0Z967 A0Z967"]
    other = ["A1B738 A1B759", "A0W951 A0W960", "A1Q954 A0L952", "A1D770 A1D964"]
    f = lambda s: plates_match(F.split(s, " ")[0], F.split(s, " ")[1])
    assert each(spark, f, same + other) == [True] * 3 + [False] * 4


def test_queue_runs_are_repeatable(spark):
    empty = ", ".join(["null"] * 12)
    q = spark.sql(f"select * from values (1, 'A', 'x', {empty}, 'OK', ''), (2, 'B', 'y', {empty}, null, null), (3, 'C', 'z', {empty}, '', null)").toDF(*[c.split()[0] for c in queue.QUEUE.split(", ")])
    done = lambda rows: rows.select("row_number", *(F.lit("1").alias(c) for c in queue.RESULT[:-2]), F.lit("REVISAR").alias("ESTADO"), F.lit("w").alias("AVISOS"))
    once = queue.run_batch(q, done, 1)
    assert [r.ESTADO for r in once.orderBy("row_number").collect()] == ["OK", "REVISAR", ""]
    assert queue.done(once).count() == 2 and [r.row_number for r in queue.pending(once).collect()] == [3]


def test_admission_and_requests(spark):
    wanted = spark.createDataFrame([(1, "a" * 12), (2, "b" * 12), (3, "c" * 12), (4, "none")], "row_number int, drive_file_id string")
    meta = spark.createDataFrame([("a" * 12, files.PDF, 5), ("b" * 12, "image/png", 10**9), ("c" * 12, files.PDF, 10**9)], "id string, mime_type string, size long")
    good, bad = files.admitted(wanted, meta)
    assert [r.row_number for r in good.collect()] == [1]
    assert {r.row_number: r.error_code for r in bad.collect()} == {2: "INVALID_DOCUMENT_TYPE", 3: "FILE_TOO_LARGE", 4: "DRIVE_FILE_NOT_FOUND"}
    bodies = ['{"plate":"A-1","drive_file_id":"abcdefghij"}', '{"plate":"--","drive_file_id":"abcdefghij"}', '{"plate":"A","drive_file_id":"abcdefghij","x":1}', "no json"]
    got = files.requests(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [r.error_code for r in got] == [None] + ["INVALID_REQUEST"] * 3


def test_tokens_and_pages(spark):
    w = spark.createDataFrame([("d", 1, k, t, 0.9, 1, 2, 30, c) for k, (t, c) in enumerate([(" a ", "96"), ("", "1"), ("b", "-1"), ("c", "x")])], "doc_id string, page int, ord int, text string, left double, top int, width int, height int, conf string")
    got = tokens.recognised_tokens(w).orderBy("ord")
    assert [(r.text, r.x, r.confidence) for r in got.collect()] == [("a", 0, 96.0), ("b", 0, None), ("c", 0, None)]
    assert tokens.chosen_pages(got).first().page == 1 and tokens.render_scales(got).first().render_scale == 1.5


def rows_of_queue(spark, folder, rows):
    empty = {c.split()[0]: None for c in queue.QUEUE.split(", ")}
    data = [tuple((empty | r).values()) for r in rows]
    spark.createDataFrame(data, queue.QUEUE).coalesce(1).write.mode("append").parquet(folder)


def last_states(spark, table):
    rows = spark.read.parquet(table).select("row_number", "batch_id", "ESTADO").collect()
    return {r.row_number: r.ESTADO for r in sorted(rows, key=lambda r: r.batch_id)}


def test_stream_processes_each_row_once_and_leaves_what_is_over_the_limit(spark, tmp_path):
    source, table, seen = f"{tmp_path}/in", f"{tmp_path}/out", []

    def process(todo):
        seen.append(sorted(r.row_number for r in todo.collect()))
        return todo.select("row_number", *(F.lit("1").alias(c) for c in queue.RESULT[:-2]), F.lit("OK").alias("ESTADO"), F.lit("").alias("AVISOS"))

    def run(limit=None):
        incoming = spark.readStream.schema(queue.QUEUE).parquet(source)
        queue.stream(spark, incoming, table, process, f"{tmp_path}/checkpoint", limit=limit).awaitTermination()

    rows_of_queue(spark, source, [dict(row_number=k, PLACA="A") for k in (1, 2, 3)] + [dict(row_number=4, ESTADO="OK")])
    run()
    assert seen == [[1, 2, 3]] and last_states(spark, table) == {1: "OK", 2: "OK", 3: "OK", 4: "OK"}
    rows_of_queue(spark, source, [dict(row_number=k) for k in (3, 5, 6)])
    run(limit=1)
    assert seen[1:] == [[5]] and last_states(spark, table) == {1: "OK", 2: "OK", 3: "OK", 4: "OK", 5: "OK", 6: None}


def test_failing_batches_are_tried_again_and_then_marked(spark):
    calls = []

    def process(todo):
        calls.append(1)
        return todo.select("row_number", F.raise_error(F.lit("down")).cast("string").alias("ESTADO")) if len(calls) < fails else todo.select("row_number", F.lit("OK").alias("ESTADO"))

    todo = spark.createDataFrame([(1,), (2,)], "row_number int")
    fails = 2
    assert [r.ESTADO for r in queue.retried(process, 2, 0)(todo).collect()] == ["OK", "OK"] and len(calls) == 2
    calls, fails = [], 9
    assert [(r.row_number, r.ESTADO, r.AVISOS, r.ANCHO) for r in queue.retried(process, 2, 0)(todo).orderBy("row_number").collect()] == [(1, "ERROR:REQUEST_FAILED", "", None), (2, "ERROR:REQUEST_FAILED", "", None)]


def test_native_tokens_and_pages_without_recognition(spark):
    words = spark.createDataFrame([("d", 0, 0, " a\u00a0", 0.9, 1.2, 0.95, 9.0), ("d", 0, 1, "  ", 0.0, 0.0, 1.0, 1.0), ("d", 1, 0, "b", 5.0, 6.0, 9.5, 7.5)], "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    got = tokens.native_tokens(words).orderBy("page").collect()
    assert [(r.page, r.text, r.x, r.y, r.width, r.height, r.confidence) for r in got] == [(1, "a", 0, 1, 1, 7, None), (2, "b", 5, 6, 4, 1, None)]
    assert tuple(tokens.chosen_pages(tokens.native_tokens(words)).first()) == ("d", 1, "native")
    many = words.where("page = 1").select("doc_id", "page", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("ord"), "text", "x0", "y0", "x1", "y1")
    assert tuple(tokens.chosen_pages(tokens.native_tokens(words.where("page = 0").unionByName(many))).first()) == ("d", 2, "native")


def test_next_values_of_ties_nulls_and_missing_keys(spark):
    a = spark.createDataFrame([(1, 5.0, "x"), (1, 5.0, "y"), (1, 9.0, "z"), (2, 1.0, "u"), (None, 1.0, "n"), (1, None, "v")], "k int, a double, tag string")
    b = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 7.0), (1, 6.0), (1, None)], "k int, v double")
    got = J.first_after(a, b, ["k"], "a", "v", "next", F.lit(-1.0)).collect()
    assert {r.tag: r.next for r in got} == {"x": 6.0, "y": 6.0, "z": -1.0, "u": -1.0, "n": -1.0, "v": -1.0} and len(got) == 6


def test_temporary_tables_go(spark, tmp_path):
    import os

    with temporary_tables(spark) as folder:
        assert stored(spark.range(3), "three").count() == 3 and os.listdir(folder)
    assert not os.path.exists(folder) and shared_folder(spark) != folder


def test_plates_that_cannot_match_do_not_reach_python(spark):
    df = spark.createDataFrame([("AAA111", "BBB222"), (None, "A1"), ("", "A1")], "a string, b string")
    assert not df.where(plates_match(F.col("a"), F.col("b"))).count()


@pytest.mark.parametrize("name", [n for n in queries.SQL if n != "document_fields"])
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    r = c.execute(queries.SQL[name])
    cols = [x[0] for x in r.description]
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted((tuple(tidy(x) for x in row) for row in r.fetchall()), key=repr)
    assert sorted((tuple(tidy(row[k]) for k in cols) for row in df.collect()), key=repr) == want
