"""Keyed attempts: rows are worked once, failing ones again after a while, over runs that end and go on."""

import time

import pytest

from fieldloom.streaming import attempts


@pytest.fixture
def job(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/out"
    calls = spark.sparkContext.accumulator(0)

    def add(rows):
        spark.createDataFrame(rows, "row_number long, payload string").coalesce(1).write.mode("append").parquet(source)

    def work(n, payload, nth):
        calls.add(1)
        if n % 5 == 0:
            raise ValueError(payload)
        return f"{n} {payload}"

    def run(work=work, **options):
        incoming = spark.readStream.schema("row_number long, payload string").parquet(source)
        attempts.settle(spark, incoming, work, table, f"{tmp_path}/checkpoint", **options).awaitTermination()
        return {r.row_number: (r.result, r.ESTADO, r.tries) for r in spark.read.schema(attempts.SETTLED).parquet(table).collect()}, spark.read.parquet(table).count()

    return add, run, calls


def test_rows_are_settled_once_over_runs_and_replays(job):
    add, run, calls = job
    add([(1, "a"), (2, "b"), (2, "c"), (3, None), (5, "e")])
    first = {1: ("1 a", "OK", 1), 2: ("2 b", "OK", 1), 3: ("3 None", "OK", 1)}
    assert run(wait_ms=1) == (first, 3) and calls.value == 4
    time.sleep(1)
    add([(1, "again"), (4, "d"), (2, "b")])
    rows, count = run(wait_ms=1)
    assert rows == first | {4: ("4 d", "OK", 1), 5: (None, "ERROR:REQUEST_FAILED", 2)} and count == 5 and calls.value == 6
    add([(5, "late"), (1, "late")])
    assert run(wait_ms=1) == (rows, 5) and calls.value == 6


def test_a_second_try_may_succeed_and_waits_for_its_time(job):
    add, run, _ = job
    add([(5, "e"), (10, "f")])
    assert run(wait_ms=3_600_000)[1] == 0
    add([(1, "a")])
    assert run(wait_ms=3_600_000) == ({1: ("1 a", "OK", 1)}, 1)


def test_another_program_goes_on_with_the_state(job):
    add, run, _ = job
    add([(5, "e")])
    assert run(wait_ms=1)[1] == 0
    time.sleep(1)
    add([(6, "f")])
    assert run(lambda n, payload, nth: f"{payload.upper()} {nth}", wait_ms=1) == ({5: ("E 2", "OK", 2), 6: ("F 1", "OK", 1)}, 2)


def test_rows_of_a_span_cost_one_read_and_one_write_of_state():
    calls = []

    class Store:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    class At:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: now

    class Handle:
        getValueState = lambda self, name, schema: Store()
        registerTimer = lambda self, at: calls.append(at)

    def work(n, payload, nth):
        if n % 5 == 0 and nth == 1:
            raise ValueError(payload)
        return f"{payload} {nth}"

    a = attempts.Attempts(work, 2, 7)
    a.init(Handle())
    numbers = [*range(-attempts.SPAN, 0)]
    rows = [{"row_number": n, "payload": p} for n in numbers for p in ("b", None, "a")]
    first = [*a.handleInputRows((-1,), iter(rows), At(100))]
    assert {r.row_number: r.result for r in first} == {n: "a 1" for n in numbers if n % 5} and calls == ["get", "update", 107]
    assert not [*a.handleInputRows((-1,), iter(rows), At(101))] and calls[3:] == ["get"]
    second = [*a.handleExpiredTimer((-1,), At(107), At(107))]
    assert {r.row_number: (r.result, r.tries) for r in second} == {n: ("a 2", 2) for n in numbers if n % 5 == 0} and calls[4:] == ["get", "update"]
    assert not [*a.handleExpiredTimer((-1,), At(108), At(107))]
