"""How quality filters interact: an audit of all orders in which they can be applied, with Spark SQL functions only.

Each document fails some of five filters; which ones is a mask of five bits.  Rows are
first counted by part (their source) and mask, so that whatever follows works on at most
32 cells a part.  Each cell then folds across the array of all 120 filter orders: a fold
along an order tells for every step whether the cell's documents stay, go here, or fail
although they are gone already.  That makes 600 structs weighted by the cell's counts,
which are added element by element over the cells of a part.

The filter for copies looks at the whole table without bringing the rows of a text
together: every row with an identifier is counted as a copy first, and the rows with the
smallest identifier of each text, found by partial minima, are moved back.

Edge cases: a null text counts as empty and fails A and, as a copy, E; B and C compare
with zero words or code points and do not fail then.  A null source is the part of the
empty string.  A row without an identifier is neither an earlier text for others nor a
copy, and has no labels.  Rows that share identifier and text are not copies of one
another.  Of several labels of an identifier any 1 counts.  An empty table gives an empty
result.  Other input columns are never read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.common import Workspace, read, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 50, 65, 5, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Keeps the rows without an identifier, which can have no label, from meeting in one task.
SPREAD = 1024


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the filters A to D that it fails."""
    text = text_or_empty(text_col)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [
        F.size("words") < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * F.size("words"),
        100 * upper.cast("long") > UPPER_PERCENT * F.length("text").cast("long"),
        F.col("text").rlike(SIGNS),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add whether any label of the row says good, and whether any says toxic (0 or 1)."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c)
    told = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    told = told.select("doc_id", F.col("quality").alias("good"), "toxic", F.lit(0).cast("long").alias("spread"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(0)
    found = rows.withColumn("spread", spread).join(told, ["doc_id", "spread"], "left").drop("spread")
    return found.na.fill(0, ["good", "toxic"])


def mask_cells(rows: DataFrame) -> DataFrame:
    """part, mask over all five filters, and its numbers of documents, good ones and toxic ones."""
    has_id = F.col("doc_id").isNotNull()
    mask = F.when(has_id, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask"))
    cells = rows.groupBy("part", mask.alias("mask"), "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    # Equal rows are counted first, so that a text or identifier of very many rows is a few rows in what follows.
    same = rows.where(has_id).groupBy("digest", "doc_id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    by_id = same.groupBy("digest", "doc_id").agg(F.collect_list(F.struct("part", "mask", "good", "toxic", "n")).alias("cells"))
    first = by_id.groupBy("digest").agg(F.min_by("cells", "doc_id").alias("cells")).select(F.inline("cells"))
    moves = F.array(F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (-F.col("n")).alias("n")), F.struct(F.col("mask"), F.col("n")))
    moved = first.select("part", "good", "toxic", F.inline(moves)).select("part", "mask", "good", "toxic", "n")
    total = lambda weight: F.sum(F.col("n") * weight)
    return cells.unionByName(moved).groupBy("part", "mask").agg(total(F.lit(1)).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


def _constant(values: list, kind: str) -> Column:
    """A nested array as one literal, which goes to every task with the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _steps(cell: Column) -> Column:
    """What a cell's documents add to each step of each order: an array of 600 structs."""
    zero = F.lit(0).cast("long")
    kinds = "array<struct<" + ",".join(f"{c}: bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(kinds).alias("steps"))

    def step(state: Column, bit: Column) -> Column:
        fails, gone = cell["mask"].bitwiseAND(bit) != 0, state["gone"]
        here = fails & ~gone
        counted = F.struct(
            F.when(~fails & ~gone, cell["n"]).otherwise(zero).alias("kept"),
            F.when(here, cell["n"]).otherwise(zero).alias("removed"),
            F.when(fails & gone, cell["n"]).otherwise(zero).alias("redundant"),
            F.when(cell["mask"] == bit, cell["n"]).otherwise(zero).alias("unique_fails"),
            F.when(here, cell["good"]).otherwise(zero).alias("good_lost"),
            F.when(here, cell["toxic"]).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(counted)).alias("steps"))

    orders = _constant([[1 << FILTERS.index(f) for f in order] for order in ORDERS], "array<array<int>>")
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step)["steps"]))


def audit_cells(cells: DataFrame) -> DataFrame:
    """One row per part, filter order and step, from the cells of the parts."""
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(FILTERS))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    # At most 32 cells a part come together.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    parts = parts.select("part", F.aggregate("cells", zeros, lambda total, cell: F.zip_with(total, _steps(cell), add)).alias("steps"))
    # Which filter each of the 600 steps applies, and what each filter removes over all of them.
    letters = _constant([FILTERS.index(f) for order in ORDERS for f in order], "array<int>")
    removed = F.zip_with("steps", letters, lambda s, f: F.struct(s["removed"].alias("removed"), f.alias("letter")))
    mine = lambda k: F.filter("removed", lambda r: r["letter"] == k)
    sums = [F.aggregate(mine(k), F.lit(0).cast("long"), lambda total, r: total + r["removed"]) for k in range(len(FILTERS))]
    parts = parts.withColumn("removed", removed).select("part", "steps", F.array(*sums).alias("shares"))
    rows = parts.select("part", "shares", F.posexplode("steps").alias("at", "step"))
    number = F.floor(F.col("at") / len(FILTERS)).cast("int")
    return rows.select(
        "part",
        F.element_at(_constant(ORDERS, "array<string>"), number + 1).alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"),
        "step.*",
        F.element_at("shares", F.element_at(letters, F.col("at") + 1) + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, for each source of ``docs``."""
    space = Workspace(docs.sparkSession, "filter-audit")
    rows = space.write(with_labels(failures(docs), labels), "rows")
    cells = space.write(mask_cells(rows), "cells")
    return audit_cells(cells)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), first AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    map {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
      'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > first_id, false)} AS fails
  FROM t JOIN first USING (text) LEFT JOIN l ON l.doc_id = t.doc_id
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter FROM orders, range(1, 6) r(step)),
s AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS failing,
    list_bool_or(list_transform(range(1, step), lambda i: fails[filter_order[i]])) IS TRUE AS gone, len(list_filter(map_values(fails), lambda v: v)) AS n_fails
  FROM c, steps
), r AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT * EXCLUDE letter, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
