"""Write-back by appended updates: the later one counts, and the table is not shuffled."""

import contextlib
import io
import uuid

import pytest

from fieldloom.operators.deltas import compact, create, merged, write_back


@pytest.fixture
def name(spark):
    made = "t" + uuid.uuid4().hex
    yield made
    for x in (made, f"{made}_updates", f"{made}_new", f"{made}_new_updates"):
        spark.sql(f"DROP TABLE IF EXISTS {x}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_later_updates_count(spark, name):
    create(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "b", 3), (None, "n", 4), (5, "e", 5)], "k int, s string, n int"), name, "k", 4)
    assert len(rows(merged(spark, name, "k"))) == 5
    first = spark.createDataFrame([(1, "x", 10), (2, None, 20), (None, "y", 30), (9, "z", 90)], "k int, s string, n long")
    for _ in range(2):  # a repeated write changes nothing
        write_back(spark, name, first, "k", 1, 4)
    expected = [(1, "x", 10), (2, None, 20), (2, None, 20), (None, "n", 4), (5, "e", 5)]
    assert rows(merged(spark, name, "k")) == sorted(expected, key=str)
    write_back(spark, name, spark.createDataFrame([(1, "p", 1), (1, "q", 0)], "k int, s string, n int"), "k", 2, 4)
    expected[0] = (1, "q", 0)
    assert rows(merged(spark, name, "k")) == sorted(expected, key=str)
    compact(spark, name, "k", f"{name}_new", 4)
    assert rows(spark.table(f"{name}_new")) == sorted(expected, key=str)
    write_back(spark, f"{name}_new", spark.createDataFrame([(5, 50)], "k int, n int"), "k", 3, 4)
    expected[4] = (5, "e", 50)
    assert rows(merged(spark, f"{name}_new", "k")) == sorted(expected, key=str)
    with pytest.raises(ValueError):
        write_back(spark, name, first.withColumnRenamed("n", "other"), "k", 4, 4)


def test_an_older_version_that_comes_late_does_not_count(spark, name):
    create(spark.createDataFrame([(1, "a")], "k int, s string"), name, "k", 2)
    for version, s in ((2, "late"), (1, "early")):
        write_back(spark, name, spark.createDataFrame([(1, s)], "k int, s string"), "k", version, 2)
    assert rows(merged(spark, name, "k")) == [(1, "late")]


def test_neither_side_is_shuffled(spark, name):
    create(spark.range(1000).selectExpr("id as k", "id as n"), name, "k", 4)
    write_back(spark, name, spark.range(10).selectExpr("id as k", "-id as n"), "k", 1, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            merged(spark, name, "k").explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in said.getvalue() and "Exchange" not in said.getvalue()


def test_empty_tables(spark, name):
    create(spark.createDataFrame([], "k int, s string"), name, "k", 2)
    write_back(spark, name, spark.createDataFrame([], "k int, s string"), "k", 1, 2)
    assert rows(merged(spark, name, "k")) == []
