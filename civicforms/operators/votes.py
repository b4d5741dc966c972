"""Feedback votes: validation, live votes, counters and rankings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LONGEST_COMMENT, LONGEST_TITLE = 1000, 100


def vote_problem(value: Column, comment: Column) -> Column:
    """Why a vote is refused, null if it is not."""
    return F.when(value.isNull() | ~value.isin(1, -1), "value").when(F.length(comment) > LONGEST_COMMENT, "comment")


def invalid_votes(votes: DataFrame) -> DataFrame:
    """Refused votes with the reason."""
    return votes.withColumn("reason", vote_problem(F.col("value"), F.col("comment"))).where("reason IS NOT NULL")


def valid_votes(votes: DataFrame) -> DataFrame:
    return votes.where(vote_problem(F.col("value"), F.col("comment")).isNull())


def counter_problem(up: Column, down: Column, old_up: Column, old_down: Column) -> Column:
    """Why a counter update is refused: negative, or a step of more than one."""
    return F.when((up < 0) | (down < 0), "negative").when((F.abs(up - old_up) > 1) | (F.abs(down - old_down) > 1), "step")


def accepts(up: int | None, down: int | None, old_up: int, old_down: int) -> str | None:
    """Why a counter write is refused, None if it is accepted: for one write, where each depends on the one accepted before."""
    if up is None or down is None:
        return "type"
    if up < 0 or down < 0:
        return "negative"
    return "step" if abs(up - old_up) > 1 or abs(down - old_down) > 1 else None


def decide_counter_writes(writes: DataFrame) -> DataFrame:
    """Writes of counters (template_id, event_id, ts, up, down) with the reason of a refusal, null if accepted.

    A refused write leaves the counters as they were, so each decision needs the one before.  The log
    of a template is therefore decided in order, with its last accepted counters as the only thing kept;
    templates are decided in parallel and no log is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, old = None, (0, 0)
        for batch in batches:
            reasons = []
            for t, up, down in zip(*(batch.column(c).to_pylist() for c in ("__template", "up", "down")), strict=True):
                if t != template:
                    template, old = t, (0, 0)
                reason = accepts(up, down, *old)
                if reason is None:
                    old = up, down
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(reasons, pa.string())], names=[*names, "reason"])

    rows = writes.select("template_id", "event_id", "ts", F.col("up").cast("long").alias("up"), F.col("down").cast("long").alias("down"))
    names = rows.columns
    # Null templates are one template, kept apart from all others.
    keyed = rows.withColumn("__template", F.coalesce(F.concat(F.lit("t"), F.col("template_id").cast("string")), F.lit("")))
    ordered = keyed.repartition("__template").sortWithinPartitions("__template", "ts", "event_id")
    return ordered.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("reason", T.StringType())]))


def accepted_counters(decided: DataFrame) -> DataFrame:
    """The counters of each template after its last accepted write, and how many writes were refused."""
    last = F.max_by(F.struct("up", "down"), F.when(F.col("reason").isNull(), F.struct("ts", "event_id")))
    return decided.groupBy("template_id").agg(last.alias("last"), F.count("reason").alias("refused")).select("template_id", F.coalesce("last.up", F.lit(0)).alias("up"), F.coalesce("last.down", F.lit(0)).alias("down"), "refused")


def proposal_problem(title: Column, description: Column) -> Column:
    """Why a proposal is refused."""
    length = F.length(F.trim(F.coalesce(title, F.lit(""))))
    return F.when((length < 1) | (length > LONGEST_TITLE), "title").when(F.length(description) > LONGEST_COMMENT, "description")


def latest_vote_per_device(votes: DataFrame) -> DataFrame:
    """The live vote of each device on each template, whole, with the time of its first."""
    newest = F.max_by(F.struct("value", "comment", "event_id"), F.struct("ts", "event_id"))
    live = valid_votes(votes).groupBy("template_id", "device_id").agg(newest.alias("vote"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return live.select("template_id", "device_id", "vote.value", "vote.comment", "created_at", "updated_at")


def vote_transitions(votes: DataFrame) -> DataFrame:
    """What each vote adds to its template's counters, given the device's vote before."""
    order = Window.partitionBy("template_id", "device_id").orderBy("ts", "event_id")
    rows = valid_votes(votes).withColumn("before", F.lag("value").over(order))
    change = lambda sign: (F.col("value") == sign).cast("int") - F.coalesce((F.col("before") == sign).cast("int"), F.lit(0))
    return rows.select("template_id", "device_id", "event_id", "ts", "value", change(1).alias("d_up"), change(-1).alias("d_down"))


def running_counters(transitions: DataFrame, stretch: str = "hour") -> DataFrame:
    """Counters of each template after each vote, never below zero.

    Summed within stretches of time, then over the stretches, so that the votes of a busy template are not sorted in one task.
    """
    rows = transitions.withColumn("__stretch", F.date_trunc(stretch, "ts"))
    earlier = Window.partitionBy("__template").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("template_id").alias("__template"), F.col("__stretch").alias("__from")).agg(F.sum("d_up").alias("__up"), F.sum("d_down").alias("__down"))
    before = sums.withColumns({c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("__up", "__down")})
    placed = rows.join(before, F.col("template_id").eqNullSafe(F.col("__template")) & F.col("__stretch").eqNullSafe(F.col("__from")))
    so_far = Window.partitionBy("template_id", "__stretch").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.greatest(F.col(f"__{c}") + F.sum(f"d_{c}").over(so_far), F.lit(0))
    return placed.withColumns({"up": total("up"), "down": total("down")}).drop("__stretch", "__template", "__from", "__up", "__down")


def vote_counts(votes: DataFrame) -> DataFrame:
    """Up and down votes of each template from live votes (A10)."""
    live = latest_vote_per_device(votes)
    return live.groupBy("template_id").agg(F.count_if(F.col("value") == 1).alias("up"), F.count_if(F.col("value") == -1).alias("down"), F.max("updated_at").alias("last_vote_at"))


def vote_ratio(counts: DataFrame) -> DataFrame:
    """Share of up votes: 1 without votes for sorting, 0 % in the badge, and its tone."""
    total = F.col("up") + F.col("down")
    ratio = F.when(total > 0, F.col("up") / total).otherwise(1.0)
    percent = F.when(total > 0, F.floor(F.col("up") * 100.0 / total + 0.5)).otherwise(0)
    tone = F.when(percent >= 75, "good").when(percent >= 40, "mixed").otherwise("bad")
    return counts.withColumns({"ratio": ratio, "percent": percent.cast("long"), "tone": tone})


def most_downvoted(counts: DataFrame, most: int = 100) -> DataFrame:
    """Templates with the most down votes (O3).  A top-k report."""
    return counts.where("down > 0").orderBy(F.desc("down"), "template_id").limit(most)


def worst_ratio(counts: DataFrame, most: int = 100) -> DataFrame:
    """The most down-voted templates, the worst ratio first."""
    return vote_ratio(most_downvoted(counts, most)).orderBy("ratio", "template_id")


def votes_for_template(votes: DataFrame, template_id: int) -> DataFrame:
    """Live votes of one template, the newest first."""
    return latest_vote_per_device(votes.where(F.col("template_id") == template_id)).orderBy(F.desc("updated_at"), "device_id")


def downvote_comments(votes: DataFrame) -> DataFrame:
    """Comments of live down votes."""
    return latest_vote_per_device(votes).where("value = -1 AND comment IS NOT NULL").select("template_id", "device_id", "comment", "updated_at")
