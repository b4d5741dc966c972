"""Exact de-duplication by a tree of merged digest runs, with Spark SQL functions only.

Each input partition first reduces its own rows to one sorted *run*: a digest, the best
row seen for it and a count.  Runs then meet in binomial rounds.  The number of a run
is written in digits of ``bits`` bits.  In round r the ``2 ** bits`` runs that differ in
digit r alone exchange: the partner with digit d gets from each of the others the
stretch whose digests have d as their r-th digit.  What it got is moved as whole
stretches, sorted, and merged multiway, keeping the best row of each digest.  A hot
digest thus adds at most ``2 ** bits`` rows to any merge, however many rows share it;
after the last round each digest lies in one run.  There are as many rounds as
digits, and no run ever holds more than its share of the digests.

The way back goes by runs too: a digest's winner is first joined to the runs that had
it, one row each, then to the rows of each run, so a hot digest's rows stay spread.

Edge cases: a null text counts as empty, so null, empty and blank texts form one
group.  Ties in length go to the smallest identifier; repeated identical rows all
stay in the output and share one ``keep_id``.  A null identifier sorts last; if only
such rows are the longest of a group, one of them is kept.  An empty table gives an
empty result.  Other input columns are never read.  Rows that stay are found again
by identifier and text, so identifiers may be missing or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.common import SPACES, Workspace, read, shuffle_width, text_or_empty

MERGE_BITS = 4
KEY = ["text_sha256", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, code points, digest of the normalised text, and the partition it was read in.

    ``check`` is a second, independent digest with the normalised length.  Rows
    are merged only where both agree, which is the verification of a match.
    ``raw`` tells texts of one group apart.  ``row`` is fixed once these rows are written.
    """
    bare = F.translate(text_or_empty(text_col), SPACES, "")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text_or_empty(text_col)).cast("long").alias("n_points"),
        F.sha2(bare.cast("binary"), 256).alias("text_sha256"),
        F.xxhash64(bare, F.octet_length(bare)).alias("check"),
        F.xxhash64(text_or_empty(text_col)).alias("raw"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
    )


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Each input partition's digests once: run, digest, best row, count, and a number drawn from the digest."""
    # The greatest is the longest text with the smallest identifier; of rows without one, any.
    best = F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("not_id"), "raw", "row")
    runs = rows.groupBy("run", *KEY).agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return runs.withColumn("draw", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"))


def merge_runs(runs: DataFrame, last_run: int, bits: int = MERGE_BITS) -> DataFrame:
    """Exchange and merge sorted runs until each digest lies in one; one row per digest."""
    runs = runs.withColumn("node", F.col("run").cast("long")).drop("run")
    width, shift = shuffle_width(runs.sparkSession), 0
    while last_run >> shift:
        digit = ((1 << bits) - 1) << shift
        node = F.col("node").bitwiseAND(~digit).bitwiseOR(F.col("draw").bitwiseAND(digit))
        # Partners' stretches go to one partition each and are merged there, in order of digest, without moving again.
        runs = runs.withColumn("node", node).repartition(width, "node").sortWithinPartitions("node", *KEY)
        runs = runs.groupBy("node", *KEY).agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"), F.first("draw").alias("draw"))
        shift += bits
    not_id = F.col("best.not_id")
    return runs.select(*KEY, F.when(not_id.isNotNull(), F.bitwise_not(not_id)).alias("keep_id"), "best.raw", F.col("best.row").alias("keep_row"), "group_size")


def _winners(docs: DataFrame, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The digests of all rows, the runs of the partitions, and the winner of each group."""
    space = Workspace(docs.sparkSession, "exact-dedup")
    rows = space.write(digests(docs, id_col, text_col), "digests")
    runs = space.write(sorted_runs(rows), "runs")
    last_run = rows.agg(F.max("run")).first()[0] or 0
    return rows, runs, merge_runs(runs, last_run, bits)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MERGE_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, runs, winners = _winners(docs, id_col, text_col, bits)
    told = runs.select("run", *KEY).join(winners.drop("raw"), KEY)
    # Rows without an identifier are not the same row, so of those one alone is kept.
    kept = F.when(F.col("keep_id").isNull(), F.col("row") == F.col("keep_row")).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return rows.drop("raw").join(told, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        kept.alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MERGE_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each group of equal texts."""
    _, _, winners = _winners(docs, id_col, text_col, bits)
    stay = winners.select(F.coalesce("keep_id", F.lit(0)).alias("__id"), F.col("keep_id").isNull().alias("__none"), F.col("text_sha256").alias("__text"), F.col("raw").alias("__raw"))
    bare = F.translate(text_or_empty(text_col), SPACES, "")
    own_id = F.col(id_col).cast("long")
    key = {"__id": F.coalesce(own_id, F.lit(0)), "__none": own_id.isNull(), "__text": F.sha2(bare.cast("binary"), 256), "__raw": F.xxhash64(text_or_empty(text_col))}
    # Both steps need rows dealt by the same key, so the texts move once.
    return docs.withColumns(key).join(stay, list(key), "left_semi").dropDuplicates(list(key)).drop(*key)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
