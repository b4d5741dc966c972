"""Listing entries: raw rows of a document listing made regular, filtered and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicforms.functions.text import blank_to_null, collapse, sanitize_filename
from civicforms.operators.county import parse_institution


def normalize_entry(raw: DataFrame, base_url: str) -> DataFrame:
    """Raw listing rows (id, path, institution_name, document_name, description, procedure, procedure_id) as entries."""
    path = F.trim(F.coalesce("path", F.lit("")))
    extension = F.when(path.contains("."), F.lower(F.element_at(F.split(path, r"\."), -1)))
    parsed = parse_institution(F.coalesce("institution_name", F.lit("")))
    text = lambda c: collapse(F.coalesce(c, F.lit("")))
    return raw.select(
        F.col("id").cast("string").alias("id"),
        "ordinal",
        *[c.alias(k) for k, c in parsed.items()],
        text("document_name").alias("document_name"),
        text("description").alias("description"),
        F.trim(F.coalesce("procedure", F.lit(""))).alias("procedure"),
        F.col("procedure_id").cast("string").alias("procedure_id"),
        extension.alias("file_extension"),
        F.when(path != "", F.concat(F.lit(base_url), path)).alias("download_url"),
        path.alias("relative_path"),
    )


def filter_extension(entries: DataFrame, extensions: list[str]) -> DataFrame:
    """Entries of the given file types."""
    return entries.where(F.col("file_extension").isin(*extensions))


def filter_downloadable(entries: DataFrame) -> DataFrame:
    """Entries with an address."""
    return entries.where(F.col("download_url").isNotNull())


def entry_path() -> Column:
    """Where an entry's file is kept: institution folder, name and id."""
    folder = F.coalesce(blank_to_null("institution"), F.lit("Unknown"))
    base = F.coalesce(blank_to_null("document_name"), F.col("id"))
    return F.concat(sanitize_filename(folder), F.lit("/"), sanitize_filename(base), F.lit("_"), F.col("id"), F.lit("."), F.coalesce("file_extension", F.lit("bin")))


def count_by_extension(entries: DataFrame) -> DataFrame:
    """Number of entries of each file type (A1)."""
    return entries.groupBy(F.coalesce("file_extension", F.lit("unknown")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def coverage_stats(entries: DataFrame) -> DataFrame:
    """How many entries have a county and a city (A2)."""
    return entries.agg(F.count(F.lit(1)).alias("total"), F.count("county").alias("with_county"), F.count("city").alias("with_city"))


def unique_procedure_ids(entries: DataFrame) -> DataFrame:
    """Distinct procedures with the place of their first entry."""
    return entries.where(F.col("procedure_id").isNotNull()).groupBy("procedure_id").agg(F.min("ordinal").alias("first_ordinal"))


def pending_work(wanted: DataFrame, key: str, *done: DataFrame, limit: int | None = None, order: str = "ordinal") -> DataFrame:
    """Rows of which no finished set has the key (J6); with ``limit`` the first so many of the queue."""
    for table in done:
        wanted = wanted.join(table.select(key).distinct(), key, "left_anti")
    return wanted if limit is None else wanted.orderBy(order, key).limit(limit)
