"""Streams: repeated deliveries, decisions that depend on earlier ones, rows tried again, sources without files."""

import random

import pytest
from pyspark.sql import functions as F

from civicforms.operators import votes
from civicforms.streaming.retry import ingest_with_retries
from civicforms.streaming.state import read_parts
from civicforms.streaming.votes import incremental_ingest, live_votes, run_counter_stream, run_vote_stream

VOTE = "template_id long, device_id long, value int, comment string, ts timestamp, event_id long"


def add(spark, rows, path):
    df = spark.createDataFrame(rows, VOTE.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_vote_stream_counts_a_repeated_event_once(spark, tmp_path):
    incoming, root = f"{tmp_path}/in", f"{tmp_path}/out"
    source = lambda: spark.readStream.schema(VOTE).parquet(incoming)
    first = [(1, 7, 1, None, "2024-01-01 00:00:00", 1), (1, 8, -1, None, "2024-01-01 00:00:01", 2), (1, 7, 1, None, "2024-01-01 00:00:00", 1)]
    second = [(1, 7, 1, None, "2024-01-01 00:00:00", 1), (1, 7, -1, None, "2024-01-02 00:00:00", 3), (1, 8, 1, None, "2023-01-01 00:00:00", 4), (2, 9, 5, None, "2024-01-01 00:00:00", 5)]
    add(spark, first, incoming)
    assert [tuple(r)[:4] for r in run_vote_stream(source(), root, 3600).collect()] == [(1, 1, 1, 2)]
    add(spark, second, incoming)
    assert [tuple(r)[:4] for r in run_vote_stream(source(), root, 3600).collect()] == [(1, 0, 2, 4)]
    seen = lambda path: spark.read.format("statestore").option("path", f"{path}/deltas-checkpoint").option("operatorId", 1).load().count()
    assert seen(root) == 4
    # With a bound that is over at once, what is remembered goes when time goes on, and live votes stay.
    short = f"{tmp_path}/short"
    for k in range(3):
        found = run_vote_stream(source(), short, 0.001)
        add(spark, [(3, k, 1, None, "2024-01-01 00:00:00", 90 + k)], incoming)
    assert [tuple(r)[:4] for r in found.where("template_id = 1").collect()] == [(1, 0, 2, 4)]
    assert seen(short) <= 1


def test_vote_stream_keeps_its_votes_in_spark_alone(spark, tmp_path):
    incoming, root = f"{tmp_path}/in", f"{tmp_path}/out"
    # A vote without an identifier is older than one of the same time with one.
    add(spark, [(1, 7, 1, None, "2024-01-01 00:00:00", 5), (1, 8, -1, None, None, 6)], incoming)
    add(spark, [(1, 7, -1, None, "2024-01-01 00:00:00", None), (None, 9, 1, None, "2024-01-01 00:00:00", 7)], incoming)
    source = spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(incoming)
    found = {r["template_id"]: tuple(r)[1:4] for r in run_vote_stream(source, root).collect()}
    assert found == {1: (1, 1, 3), None: (1, 0, 1)}
    # No call from the JVM to Python for each (template, device).
    assert "TransformWithState" not in live_votes(source)._jdf.queryExecution().analyzed().toString()


def test_sources_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    empty = spark.readStream.schema(VOTE).parquet(f"{tmp_path}/in")
    assert run_vote_stream(empty, f"{tmp_path}/a").collect() == []
    good, dead = incremental_ingest(empty, f"{tmp_path}/b", "event_id", F.lit(None).cast("string"))
    assert good.collect() == dead.collect() == []
    good, dead = ingest_with_retries(empty, f"{tmp_path}/c", "event_id", lambda df: df.withColumn("reason", F.lit(None).cast("string")))
    assert good.collect() == dead.collect() == []


def test_failed_rows_are_tried_again(spark, tmp_path):
    incoming, root, there = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/there"
    shape = "id int, v string"

    def attempt(df):
        known = spark.read.schema("id int, ok boolean").parquet(there)
        return df.join(known, "id", "left").withColumn("reason", F.when(F.col("ok"), F.lit(None).cast("string")).otherwise("not there")).drop("ok")

    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "x")], shape).coalesce(1).write.parquet(incoming)
    good_of, dead_of = [], []
    for found in ([1], [], [2]):
        spark.createDataFrame([(i, True) for i in found], "id int, ok boolean").coalesce(1).write.mode("append").parquet(there)
        good, dead = ingest_with_retries(spark.readStream.schema(shape).parquet(incoming), root, "id", attempt, pause=0.001)
        good_of.append(sorted(map(tuple, good.collect())))
        dead_of.append(sorted((tuple(r) for r in dead.collect()), key=str))
    assert good_of == [[(1, "a")], [(1, "a")], [(1, "a"), (2, "b")]]
    no_key = (None, "x", "given_up", 0, "no key")
    assert dead_of[2] == [no_key]
    assert [(r[0], r[4]) for r in dead_of[0] + dead_of[1] if r[0]] == [(2, "not there")] * 2
    failures = [r[3] for r in dead_of[0] + dead_of[1] if r[0]]
    assert failures[0] <= failures[1] <= 3


def test_a_row_is_given_up_and_may_come_again(spark, tmp_path):
    incoming, root = f"{tmp_path}/in", f"{tmp_path}/out"
    shape = "id int, v string"
    attempt = lambda df: df.withColumn("reason", F.when(F.col("v") == "bad", "bad"))
    run = lambda: ingest_with_retries(spark.readStream.schema(shape).parquet(incoming), root, "id", attempt, most=2, pause=0.001)
    spark.createDataFrame([(1, "bad")], shape).coalesce(1).write.parquet(incoming)
    for _ in range(3):
        good, dead = run()
    assert [tuple(r) for r in dead.collect()] == [(1, "bad", "given_up", 2, "bad")]
    spark.createDataFrame([(1, "good")], shape).coalesce(1).write.mode("append").parquet(incoming)
    good, dead = run()
    assert [tuple(r) for r in good.collect()] == [(1, "good")]
    assert dead.collect() == []


def random_log(seed):
    rng = random.Random(seed)
    log, at = [], {}
    for k in range(400):
        t = rng.choice([None, 1, 2, 2, 2])
        up, down = at.get(t, (0, 0))
        up, down = up + rng.choice([-1, 0, 0, 1, 1, 2, 5]), down + rng.choice([0, 0, 1, -1, 3])
        if rng.random() < 0.7:
            at[t] = (up, down)  # as the writer believes, whether it was refused or not
        log.append((t, k, f"2024-01-01 00:{k // 60 % 60:02}:{k % 60:02}", None if rng.random() < 0.02 else up, down))
    return log


def decided(log):
    out, counters = {}, {}
    for t, k, _, up, down in log:
        a, b = counters.get(t, (0, 0))
        reason = "type" if up is None else "negative" if min(up, down) < 0 else "step" if abs(up - a) > 1 or abs(down - b) > 1 else None
        if reason is None:
            counters[t] = (up, down)
        out[k] = reason
    return out, counters


WRITE = "template_id long, event_id long, ts string, up int, down int"


@pytest.mark.parametrize("seed", [1, 2])
def test_counter_writes_are_decided_in_order(spark, seed):
    log = random_log(seed)
    rows = votes.decide_counter_writes(spark.createDataFrame(log, WRITE).repartition(5))
    want, counters = decided(log)
    assert {r["event_id"]: r["reason"] for r in rows.collect()} == want
    assert {"step", "negative", None} <= set(want.values())
    assert {r["template_id"]: (r["up"], r["down"]) for r in votes.accepted_counters(rows).collect()} == {t: counters.get(t, (0, 0)) for t in (None, 1, 2)}


def test_counter_stream_is_the_batch(spark, tmp_path):
    log = [r for r in random_log(3) if r[3] is not None]
    for part in (log[:150], log[150:]):
        spark.createDataFrame(part, WRITE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = run_counter_stream(spark.readStream.schema(WRITE).parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
    assert {r["event_id"]: r["reason"] for r in rows.collect()} == decided(log)[0]


def test_parts_of_nothing(spark, tmp_path):
    assert read_parts(spark, spark.range(1).schema, f"{tmp_path}/none").columns == ["id", "batch"]
