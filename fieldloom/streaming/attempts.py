"""Queue rows worked off once each, with a second try, by keyed state in the state store.

A key is a span of SPAN row numbers, as each key costs several calls to the state store. Its state has a bit for each row
that came, and what is open: the rows that wait, how often each was tried, and when it is due. So a row that comes again, in a
replayed batch or a later run, adds nothing, and no result table is read. A try that fails sets a timer; when that is
due the row is tried again, alone, and after the last try it is settled with an error. State and timers live in the
checkpoint, so a run that ends between two tries goes on where it was. A state is bounded by its span: 128 bytes, and the
payloads of the rows that wait. Checkpoints from before the spans can't be gone on with."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: The state store with timers, and no batches without input, for with timers a run over what is there would never end.
NEEDED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Row numbers of a key, a power of two.
SPAN = 1 << 10
SETTLED = "row_number long, result string, ESTADO string, tries int"


class Attempts(StatefulProcessor):
    """work(row number, payload, number of the try from 1) gives a result, or raises where the try fails. It runs once for each
    try of a row."""

    def __init__(self, work: Callable[[int, str | None, int], Any], tries: int = 2, wait_ms: int = 5000):
        self.work, self.most, self.wait_ms = work, tries, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "came binary, open array<struct<row_number: long, tries: int, due: long, payload: string>>")

    def attempt(self, key: int | None, tries: int, payload: str | None, now: int, waiting: list[tuple]) -> Iterator[Row]:
        result, state = None, "OK"
        try:
            result = self.work(key, payload, tries + 1)
        except Exception:  # noqa: BLE001  a row that fails is tried again or settled with an error, and never ends the run
            if tries + 1 < self.most:
                waiting.append((key, tries + 1, now + self.wait_ms, payload))
                return
            state = "ERROR:REQUEST_FAILED"
        yield Row(row_number=key, result=None if result is None else str(result), ESTADO=state, tries=tries + 1)

    def load(self) -> tuple[int, list[tuple]]:
        found = self.state.get()
        return (0, []) if found is None else (int.from_bytes(found[0], "little"), [tuple(x) for x in found[1]])

    def keep(self, came: int, waiting: list[tuple], due: set[int]) -> None:
        """due: the timers that are set already."""
        self.state.update((came.to_bytes(SPAN // 8, "little"), waiting))
        for at in {w[2] for w in waiting} - due:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        (came, waiting), now, new = self.load(), timerValues.getCurrentProcessingTimeInMs(), {}
        for n, payload in ((r["row_number"], r["payload"]) for r in rows):
            if not came >> ((n or 0) % SPAN) & 1:  # else it is settled, or its timer will try it
                new[n] = min(new.get(n, payload), payload, key=lambda p: (p is None, p))
        if not new:
            return
        due = {w[2] for w in waiting}
        for n, payload in new.items():
            came |= 1 << (n or 0) % SPAN
            yield from self.attempt(n, 0, payload, now, waiting)
        self.keep(came, waiting, due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        (came, waiting), now = self.load(), timerValues.getCurrentProcessingTimeInMs()
        ready = [w for w in waiting if w[2] <= expiredTimerInfo.getExpiryTimeInMs()]
        if not ready:
            return
        later = [w for w in waiting if w[2] > expiredTimerInfo.getExpiryTimeInMs()]
        due = {w[2] for w in later}
        for n, tries, _, payload in ready:
            yield from self.attempt(n, tries, payload, now, later)
        self.keep(came, later, due)

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings that keyed state with timers needs; a query that is started inside keeps them."""
    before = {k: spark.conf.get(k, None) for k in NEEDED}
    for k, v in NEEDED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def settled(rows: DataFrame, work: Callable[[int, str | None, int], Any], tries: int = 2, wait_ms: int = 5000) -> DataFrame:
    """The stream of settled rows of a stream (row_number long, payload string). Of several rows of one number that arrive in
    one batch, the one with the smallest payload is worked."""
    spans = rows.withColumn("_span", F.shiftright("row_number", SPAN.bit_length() - 1))
    return spans.groupBy("_span").transformWithState(Attempts(work, tries, wait_ms), outputStructType=SETTLED, outputMode="Append", timeMode="ProcessingTime")


def settle(spark: SparkSession, rows: DataFrame, work: Callable[[int, str | None, int], Any], table: str, checkpoint: str, tries: int = 2, wait_ms: int = 5000, every: str | None = None) -> StreamingQuery:
    """Appends what is settled to a table of files, once over what is there or on an interval. Timers are looked at in each batch
    with input. Files and state are committed
    together, so a batch that is delivered again writes its rows once."""
    with keyed_state(spark):
        writer = settled(rows, work, tries, wait_ms).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
