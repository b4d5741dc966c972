"""Ingestion that tries failed rows again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from civicforms.storage import made
from civicforms.streaming.state import ARRIVED, arriving, read_parts, run_to_parts

Attempt = Callable[[DataFrame], DataFrame]


class Attempts(StatefulProcessor):
    """A key's way from pending over failures to done.

    A row without a reason makes its key done, once and for good.  A failed one is kept as
    state; a timer brings it back after a pause that doubles with each failure.  After
    ``most`` failures it is given up: no timer any more, though a later delivery may still succeed.
    """

    def __init__(self, columns: T.StructType, most: int, pause: int) -> None:
        self.columns, self.most, self.pause = columns, most, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = [T.StructField("failures", T.IntegerType()), T.StructField("done", T.BooleanType()), T.StructField("due", T.LongType())]
        self.state = handle.getValueState("attempts", T.StructType(own + self.columns.fields))

    def _event(self, status: str, failures: int, reason: str | None, values: tuple) -> Row:
        return Row("status", "failures", "reason", *self.columns.names)(status, failures, reason, *values)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[1]:  # the mark of a run
            return
        if key[0] is None:
            for row in rows:
                yield self._event("given_up", 0, "no key", tuple(row[c] for c in self.columns.names))
            return
        known = self.state.get() if self.state.exists() else None
        failures, done, due = tuple(known)[:3] if known else (0, False, None)
        if done:
            return
        failed = None
        for row in rows:
            values = tuple(row[c] for c in self.columns.names)
            if row["reason"] is None:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.state.update((failures, True, None, *[None] * len(values)))
                yield self._event("done", failures, None, values)
                return
            failures += 1
            failed = values, row["reason"], int(row[ARRIVED].timestamp() * 1000)
        values, reason, now = failed
        if due is not None:
            self.handle.deleteTimer(due)
        due = now + self.pause * 2 ** (failures - 1) if failures < self.most else None
        if due is not None:
            self.handle.registerTimer(due)
        self.state.update((failures, False, due, *values))
        yield self._event("failed" if due is not None else "given_up", failures, reason, values)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        failures, done, _, *values = tuple(self.state.get())
        if not done:
            self.state.update((failures, False, None, *values))
            yield self._event("due", failures, None, tuple(values))

    def close(self) -> None:
        pass


def ingest_with_retries(source: DataFrame, root: str, key: str, attempt: Attempt, most: int = 3, pause: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """Take in what is there of a streamed source; returns the good rows and the dead letters so far.

    ``attempt`` adds a text column ``reason``, null where a row is good; it may look things up, so that
    what fails now can succeed later.  Run this again to go on: unseen files are read, and rows whose
    pause (in seconds) is over are tried again, together with what they are joined to by then.  A key
    is taken in once, however often it is delivered.  Its failures are dead letters until it succeeds.
    All is kept under ``root``: events by batch, rows that wait to be tried again, and checkpoints.
    """
    spark, columns = source.sparkSession, source.schema
    events, retries = f"{root}/events", made(spark, f"{root}/retries")
    mark = T.StructField("__mark", T.BooleanType())
    # A mark that belongs to no key lets time go on where nothing else arrives.
    spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in columns], F.lit(True).alias("__mark")).write.mode("append").parquet(f"{retries}/marks")
    event = T.StructType([T.StructField("status", T.StringType()), T.StructField("failures", T.IntegerType()), T.StructField("reason", T.StringType()), *columns.fields])

    def feed_back(batch: DataFrame, number: int) -> None:
        due = batch.where("status = 'due'").select(*columns.names, F.lit(False).alias("__mark"))
        due.write.mode("overwrite").parquet(f"{retries}/batch-{number}")

    due_so_far = lambda: read_parts(spark, event, events).where("status = 'due'").count()
    waiting = due_so_far()
    while True:
        again = spark.readStream.schema(T.StructType([*columns.fields, mark])).option("recursiveFileLookup", "true").parquet(retries)
        rows = source.withColumn("__mark", F.lit(False)).unionByName(again)
        tried = arriving(attempt(rows))
        states = tried.groupBy(key, "__mark").transformWithState(Attempts(columns, most, round(pause * 1000)), event, "Update", "EventTime")
        run_to_parts(states, events, feed_back)
        due, waiting = waiting, due_so_far()
        if due == waiting:
            break
        # Rows whose pause was over came back in this run; the next one tries them.
    last = read_parts(spark, event, events).where("status <> 'due'")
    state = last.groupBy(key).agg(F.max(F.col("status") == "done").alias("done"))
    good = last.where("status = 'done'").select(*columns.names)
    failed = last.where("status <> 'done'").join(state.where("NOT done").select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    dead = failed.where(F.col(key).isNull()).unionByName(
        failed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*failed.columns), F.struct("failures", "batch")).alias("last")).select("last.*")
    )
    return good, dead.select(*columns.names, "status", "failures", "reason")
