"""Sources: manifests, keyed maps, file listings, detector outputs and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_manifest(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Entries of a JSON manifest, ``[...]`` or ``{"entries": [...]}``, with their ordinal (S1).  ``entry``: DDL of a struct."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    bare = F.from_json("value", f"array<struct<{entry}>>")
    wrapped = F.from_json("value", f"struct<entries: array<struct<{entry}>>>")["entries"]
    rows = raw.select(F.posexplode(F.when(F.col("value").startswith("["), bare).otherwise(wrapped)).alias("ordinal", "entry"))
    return rows.select("ordinal", "entry.*")


def scan_keyed_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Rows of a JSON object keyed by identifier (S2).  ``value``: DDL of a struct."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string, struct<{value}>>")).alias("key", "item")).select("key", "item.*")


def scan_files_by_suffix(spark: SparkSession, root: str, *suffixes: str) -> DataFrame:
    """path and length of files with one of the suffixes, whatever case; contents are not read (S3)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.lower("path").endswith(suffix.lower())
    return files.where(wanted)


def scan_bundles(files: DataFrame, bundle: int | None = None) -> DataFrame:
    """Files in folders ``bundle-<n>``, with the number, in numeric order; of one bundle if asked."""
    number = F.regexp_extract("path", r"/bundle-(\d+)/", 1)
    rows = files.withColumn("bundle", F.nullif(number, F.lit("")).cast("int")).where("bundle IS NOT NULL")
    return (rows if bundle is None else rows.where(F.col("bundle") == bundle)).orderBy("bundle", "path")


def scan_pages_html(spark: SparkSession, path: str) -> DataFrame:
    """Web pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


DETECTOR = "source string, avgConfidence double, fields array<struct<type: string, page: int, x: double, y: double, width: double, height: double, label: string, confidence: double, context: string>>"


def scan_detector_outputs(spark: SparkSession, root: str, wanted: DataFrame | None = None, counts: Observation | None = None) -> DataFrame:
    """Detector files ``*.fields.json`` with bundle, stem and number of fields.

    ``status`` is read, broken or missing: a broken file counts no fields, and neither does one that ``wanted``
    (bundle, stem) names but that is not there.  With ``counts`` the number of each is taken while the rows are used.
    """
    schema = T.StructType([*T.StructType.fromDDL(DETECTOR).fields, T.StructField("__broken", T.StringType())])
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.fields.json").option("multiLine", "true").option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", "__broken").schema(schema).json(root)
    path = F.col("_metadata.file_path")
    rows = rows.select(
        F.nullif(F.regexp_extract(path, r"/(bundle-\d+)/", 1), F.lit("")).alias("bundle"), F.regexp_extract(path, r"([^/]+)\.fields\.json$", 1).alias("stem"),
        "source", "avgConfidence", "fields", F.when(F.col("__broken").isNotNull(), "broken").otherwise("read").alias("status"),
    )
    if wanted is not None:
        rows = wanted.select("bundle", "stem").distinct().join(rows, ["bundle", "stem"], "left")
    rows = rows.select("bundle", "stem", "source", F.coalesce("avgConfidence", F.lit(0.0)).alias("avg_confidence"), "fields", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"), F.coalesce("status", F.lit("missing")).alias("status"))
    if counts is None:
        return rows
    return rows.observe(counts, *[F.count_if(F.col("status") == s).alias(s) for s in ("read", "broken", "missing")])


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Slim rows of a catalog of JSON lines, plain or gzip."""
    return spark.read.json(path)
