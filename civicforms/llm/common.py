"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute usable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.storage import Workspace, shared_dir  # noqa: F401  used by the operators

#: Characters that the word and equality rules treat as white space: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_hash(column: str = "doc_id") -> F.Column:
    """crc32 of the identifier written as text, the rule that names held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into row ranges of about ``limit`` bytes of text, so that memory does not follow row lengths.

    Null texts come back as empty strings.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if total and total + size > limit:
                part = batch.slice(start, row - start)
                yield part, [x or "" for x in part.column(column).to_pylist()]
                start, total = row, 0
            total += size
        if start < len(sizes):
            part = batch.slice(start)
            yield part, [x or "" for x in part.column(column).to_pylist()]


def cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends among sorted hashes: equal ranges of hash values."""
    borders = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, borders), [len(hashes)]])


def fewest_hashes(rows: DataFrame, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows: all, or those whose hash of ``doc_id`` lies below a bound.

    The bound is the hash that comes after the ``most`` smallest, found among about twice
    as many hashes, so that no task sorts more however many partitions there are.  Rows
    of one identifier stay or go together.
    """
    there = rows.count()
    if there <= most:
        return rows
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    bound = min((2 * most << 64) // there - (1 << 63), (1 << 63) - 1)
    near = rows.select(h.alias("h")).where(F.col("h") < F.lit(bound)).orderBy("h").limit(most + 1)
    found = near.agg(F.count("h").alias("n"), F.max("h").alias("last")).first()
    return rows.where(h < F.lit(found["last"] if found["n"] > most else bound))
