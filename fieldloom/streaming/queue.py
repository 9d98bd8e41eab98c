"""A resumable job over a queue of work: pending rows in order, up to a limit, written back by row number."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import ordered_text
from ..operators.joins import upsert
from ..operators.tables import merged_in, stored
from ..plans.extract import Extraction, rejects, values
from ..plans.spec import NAMES

RESULT = [*NAMES, "ESTADO", "AVISOS"]
QUEUE = "row_number int, PLACA string, ID_DRIVE string, " + ", ".join(f"{n} string" for n in NAMES) + ", ESTADO string, AVISOS string"


def pending(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows without a state, the first `limit` of them by row number."""
    todo = queue.where(F.col("ESTADO").isNull() | (F.col("ESTADO") == ""))
    return todo.orderBy("row_number").limit(limit) if limit is not None else todo


def done(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("ESTADO").isin("OK", "REVISAR"))


def updates(e: Extraction, rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The result of each row (row_number, doc_id): values with OK, or REVISAR where there are warnings; ERROR and its code
    for documents that were turned away or gave nothing. Both branches meet in one table."""
    codes = merged_in(e.warnings.groupBy("doc_id").agg(ordered_text("code", ["ord"], ", ").alias("AVISOS")))
    bad = rejects(e.documents) if errors is None else rejects(e.documents).unionByName(errors.select("doc_id", "error_code"))
    bad = merged_in(bad.groupBy("doc_id").agg(F.min("error_code").alias("error_code")))
    good = rows.join(bad, "doc_id", "left_anti").join(values(e.results), "doc_id").join(codes, "doc_id", "left")
    good = good.withColumn("ESTADO", F.when(F.col("AVISOS").isNull(), "OK").otherwise("REVISAR")).withColumn("AVISOS", F.coalesce("AVISOS", F.lit("")))
    failed = rows.join(bad, "doc_id").select("row_number", F.concat(F.lit("ERROR:"), F.coalesce("error_code", F.lit("REQUEST_FAILED"))).alias("ESTADO"), F.lit("").alias("AVISOS"))
    return good.select("row_number", *RESULT).unionByName(failed, allowMissingColumns=True)


def run_batch(queue: DataFrame, process: Callable[[DataFrame], DataFrame], limit: int | None = 200) -> DataFrame:
    """The queue after one run: `process` maps pending rows to updates; rows already done are not touched, so a run that
    is repeated changes nothing."""
    return upsert(queue, merged_in(process(pending(queue, limit))), "row_number", RESULT)


def retried(process: Callable[[DataFrame], DataFrame], tries: int = 2, wait: float = 5.0) -> Callable[[DataFrame], DataFrame]:
    """process with its rows made at once, tried again after `wait` seconds where that fails; when the last try fails its
    rows get an error of their own, so that one batch never ends the run."""

    def attempt(rows: DataFrame) -> DataFrame:
        for left in range(tries - 1, -1, -1):
            try:
                return stored(process(rows), "updates")
            except (PySparkException, Py4JError):
                if left:
                    time.sleep(wait)
        failed = rows.select("row_number", F.lit("ERROR:REQUEST_FAILED").alias("ESTADO"), F.lit("").alias("AVISOS"))
        return failed.select(failed.row_number, *(F.col(c) if c in failed.columns else F.lit(None).cast("string").alias(c) for c in RESULT))

    return attempt


def stream(spark: SparkSession, incoming: DataFrame, table: str, process: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None, limit: int | None = None):
    """Each batch of a stream of queue rows is processed and appended under its batch id; a batch that is delivered again
    replaces what it wrote before, and rows that are done already are skipped. It runs once over what is there, or with
    `every` (such as "20 minutes") on that interval; `limit` bounds the rows of a batch that are processed, and the others
    stay pending: a row stands in the table once for each batch it came in, and the last counts. How much a batch takes in is the source's own option (maxFilesPerTrigger)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = stored(batch, "batch")
        low, high = batch.agg(F.min("row_number"), F.max("row_number")).first()
        if low is None:
            return
        todo = batch
        if exists(session, table):
            # Only row numbers are read, and only from files and row groups that can hold this batch's.
            before = session.read.schema(QUEUE + ", batch_id long").parquet(table).where(F.col("row_number").between(low, high) & (F.col("batch_id") != batch_id))
            todo = batch.join(done(before).select("row_number"), "row_number", "left_anti")
        out = upsert(todo, process(pending(todo, limit)), "row_number", RESULT)
        out.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    writer = incoming.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
