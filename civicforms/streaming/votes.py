"""Votes and counter writes as streams, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from civicforms.operators.votes import accepts, valid_votes
from civicforms.streaming.state import arriving, read_parts, run_to_parts

#: A vote without a time is older than all others.
NO_TIME = -(1 << 55)
LIVE = "template_id long, device_id long, vote struct<micros: long, event_id: long, value: int>, events long"


def live_votes(votes: DataFrame, repeat: float = 86_400.0) -> DataFrame:
    """The live vote of each device on each template that a batch of a stream touched, and how many events it had so far.

    There is one small state for each (template, device), kept for good, because a vote can be changed
    at any time.  Rows may come in any order: a vote older than the known one changes nothing.  An event
    delivered again within ``repeat`` seconds of its first arrival counts once in ``events``; what is
    remembered for that goes once the watermark has passed it.
    """
    key = ["template_id", "device_id"]
    rows = valid_votes(votes).select(*key, "value", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NO_TIME)).alias("micros"), "event_id")
    once = arriving(rows, repeat).dropDuplicatesWithinWatermark([*key, "event_id"])
    return once.groupBy(*key).agg(F.max(F.struct("micros", "event_id", "value")).alias("vote"), F.count(F.lit(1)).alias("events"))


def run_vote_stream(votes: DataFrame, root: str, repeat: float = 86_400.0) -> DataFrame:
    """Consume what is there of a vote stream and return the counters so far; run again to go on.

    Live votes are written by batch number, so a batch that is repeated after a failure replaces itself; the latest batch
    that has a key holds all there is of it.
    """
    run_to_parts(live_votes(votes, repeat), f"{root}/deltas")
    parts = read_parts(votes.sparkSession, T.StructType.fromDDL(LIVE), f"{root}/deltas")
    live = parts.groupBy("template_id", "device_id").agg(F.max(F.struct("batch", "vote", "events")).alias("last")).select("template_id", "last.vote.*", "last.events")
    last_vote_at = F.timestamp_micros(F.nullif(F.max("micros"), F.lit(NO_TIME))).alias("last_vote_at")
    return live.groupBy("template_id").agg(F.count_if(F.col("value") == 1).alias("up"), F.count_if(F.col("value") == -1).alias("down"), F.sum("events").alias("events"), last_vote_at)


DECISION = "template_id long, event_id long, up long, down long, reason string"


class CounterState(StatefulProcessor):
    """The counters of a template as the last accepted write left them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "up long, down long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = tuple(self.counters.get()) if self.counters.exists() else (0, 0)
        # The writes of one batch are decided in the order in which they were made.
        for row in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            reason = accepts(row["up"], row["down"], *old)
            if reason is None:
                old = row["up"], row["down"]
            yield Row(template_id=key[0], event_id=row["event_id"], up=row["up"], down=row["down"], reason=reason)
        self.counters.update(old)

    def close(self) -> None:
        pass


def run_counter_stream(writes: DataFrame, root: str) -> DataFrame:
    """Decide on a stream of counter writes (template_id, event_id, ts, up, down); returns all writes so far, with the reason of a refusal."""
    keyed = writes.select("template_id", "event_id", "ts", "up", "down")
    run_to_parts(keyed.groupBy("template_id").transformWithState(CounterState(), DECISION, "Update", "None"), f"{root}/decisions")
    return read_parts(writes.sparkSession, T.StructType.fromDDL(DECISION), f"{root}/decisions").drop("batch")


def incremental_ingest(source: DataFrame, root: str, key: str, problem: F.Column) -> tuple[DataFrame, DataFrame]:
    """Take in unseen files of a streamed source: good rows and dead letters with a reason.

    The checkpoints remember which files were read, and as state which keys were taken in, so that the
    rows written before are never read again.  Of rows with one key the first taken in stays.  To try
    failed rows again, see ``retry``.
    """
    marked = source.withColumn("reason", problem)
    parts = {"rows": marked.where("reason IS NULL").drop("reason").dropDuplicates([key]), "dead": marked.where("reason IS NOT NULL")}
    for name, rows in parts.items():
        run_to_parts(rows, f"{root}/{name}", mode="append")
    good, dead = (read_parts(source.sparkSession, rows.schema, f"{root}/{name}").drop("batch") for name, rows in parts.items())
    return good, dead
