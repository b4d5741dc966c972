"""Sinks: catalogs, bundles, sitemaps, keyed stores, logs and routed outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from civicforms.operators.catalog import sitemap_lines
from civicforms.operators.votes import proposal_problem

#: The store takes this many bytes inline, and this many at most.
INLINE_LIMIT, STORE_LIMIT = 900_000, 1_000_000


def sink_slim_catalog(slim: DataFrame, path: str, generated_at: str | None = None) -> DataFrame:
    """Write slim rows by name as gzip JSON lines (K1).

    Returns one row of metrics: rows, JSON bytes, gzip bytes as written, the form the store
    takes (``inline`` up to INLINE_LIMIT bytes of JSON, else ``gzip``), whether the gzip form
    passes the store's limit, and the time of generation.
    """
    spark, told = slim.sparkSession, Observation()
    size = F.sum(F.octet_length(F.to_json(F.struct(*slim.columns))))
    # Counted as they are written: above the sort, whose sampling reads what is below it once more.
    ordered = slim.orderBy(F.collate("name", "ro"), "id")
    ordered.observe(told, F.count(F.lit(1)).alias("count"), F.coalesce(size, F.lit(0)).alias("json_bytes")).write.mode("overwrite").json(path, compression="gzip")
    written = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("gzip_bytes"))
    both = written.withColumns({k: F.lit(told.get[k]).cast("long") for k in ("count", "json_bytes")})
    form = F.when(F.col("json_bytes") <= INLINE_LIMIT, "inline").otherwise("gzip")
    generated = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return both.withColumns({"form": form, "over_limit": (form == "gzip") & (F.col("gzip_bytes") > STORE_LIMIT), "generated_at": generated})


def sink_procedures_bundle(procedures: DataFrame, path: str) -> None:
    """Write nested procedures as JSON, one folder a county (K2)."""
    procedures.write.mode("overwrite").partitionBy("county_bucket").json(path)


def sink_sitemap(rows: DataFrame, path: str) -> None:
    """Write sitemap elements as text (K3)."""
    sitemap_lines(rows).write.mode("overwrite").text(path)


def keyed_merge(target: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """The target with the non-null columns of patches laid over it; unknown keys are added (K4)."""
    both = target.alias("t").join(patches.alias("p"), key, "full")
    columns = [F.coalesce(F.col(f"p.{c}"), F.col(f"t.{c}")).alias(c) if c in patches.columns else F.col(f"t.{c}") for c in target.columns if c != key]
    return both.select(key, *columns)


def sink_run_log(status: DataFrame, fields: DataFrame, path: str) -> None:
    """Append one record per document and one per field (K5)."""
    status.write.mode("append").json(f"{path}/documents")
    fields.write.mode("append").json(f"{path}/fields")


def sink_routed(documents: DataFrame, path: str, threshold: float = 0.99) -> None:
    """Write documents to ``processed`` or ``needs-review`` by confidence (K6)."""
    routed = documents.withColumn("status", F.when(F.col("avg_confidence") >= threshold, "processed").otherwise("needs-review"))
    routed.write.mode("overwrite").partitionBy("status").parquet(path)


def sink_proposals(proposals: DataFrame, path: str) -> DataFrame:
    """Append proposals (title, description) that nothing speaks against, with the time of writing; returns the refused ones with the reason."""
    judged = proposals.withColumn("reason", proposal_problem(F.col("title"), F.col("description")))
    judged.where("reason IS NULL").drop("reason").withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
    return judged.where("reason IS NOT NULL")
