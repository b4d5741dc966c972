"""Writers that no query calls."""

import json

from pyspark.sql import functions as F

from civicforms.operators import catalog
from civicforms.sources import sinks
from civicforms.storage import Workspace


def test_slim_catalog(spark, tmp_path):
    small = spark.createDataFrame([("b", "Țară"), ("a", "tara"), ("c", None)], "id string, name string")
    found = sinks.sink_slim_catalog(small, str(tmp_path / "small"), "2024-05-06T07:08:09Z").first()
    size = sum(len(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False, separators=(",", ":")).encode()) for r in ({"id": "b", "name": "Țară"}, {"id": "a", "name": "tara"}, {"id": "c", "name": None}))
    assert (found["count"], found["json_bytes"], found["form"], found["over_limit"], found["generated_at"]) == (3, size, "inline", False, "2024-05-06T07:08:09Z")
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "small")).collect()) == ["a", "b", "c"]
    # Above the inline limit; of equal rows gzip leaves little, of random ones too much.
    equal = spark.range(20_000).selectExpr("concat('t', id) AS id", "repeat('x', 100) AS name")
    found = sinks.sink_slim_catalog(equal, str(tmp_path / "equal")).first()
    assert (found["form"], found["over_limit"]) == ("gzip", False)
    mixed = spark.range(40_000).select(F.concat(F.lit("t"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    found = sinks.sink_slim_catalog(mixed, str(tmp_path / "mixed")).first()
    assert found["form"] == "gzip"
    assert found["over_limit"] == (found["gzip_bytes"] > sinks.STORE_LIMIT) is True


def test_proposals(spark, tmp_path):
    rows = [(1, "good", None), (2, " ", "d"), (3, None, "d"), (4, "t" * 101, "d"), (5, "t" * 100, "d" * 1000), (6, "t", "d" * 1001)]
    refused = sinks.sink_proposals(spark.createDataFrame(rows, "id int, title string, description string"), str(tmp_path / "p"))
    assert sorted((r["id"], r["reason"]) for r in refused.collect()) == [(2, "title"), (3, "title"), (4, "title"), (6, "description")]
    kept = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(r["id"] for r in kept.where("created_at IS NOT NULL").collect()) == [1, 5]


def test_bundles_logs_and_routes(spark, tmp_path):
    procedures = spark.createDataFrame([("1", "Cluj", "a"), ("2", "Iași", "b"), ("3", "Cluj", None)], "procedure_id string, county_bucket string, title string")
    sinks.sink_procedures_bundle(procedures, str(tmp_path / "b"))
    assert sorted((r["procedure_id"], r["county_bucket"]) for r in spark.read.json(str(tmp_path / "b")).collect()) == [("1", "Cluj"), ("2", "Iași"), ("3", "Cluj")]
    status = spark.createDataFrame([(1, 0.995), (2, 0.99), (3, 0.5), (4, None)], "doc_id int, avg_confidence double")
    for _ in range(2):
        sinks.sink_run_log(status, status.select("doc_id"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log/documents")).count() == spark.read.json(str(tmp_path / "log/fields")).count() == 8
    sinks.sink_routed(status, str(tmp_path / "r"))
    assert sorted((r["doc_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [(1, "processed"), (2, "processed"), (3, "needs-review"), (4, "needs-review")]
    slim = spark.createDataFrame([("t<1>", "n", False), ("t2", "n", True)], "id string, name string, archived boolean")
    sinks.sink_sitemap(catalog.sitemap_rows(slim, "https://x.example", "2024-05-06T00:00:00Z"), str(tmp_path / "s"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "s")).collect())
    assert text.count("<loc>") == 3
    assert "https://x.example/fill/t&lt;1&gt;" in text


def test_workspace_closes(spark):
    with Workspace(spark, "closing") as space:
        path = space.root
        assert space.write(spark.range(3), "t").count() == 3
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
