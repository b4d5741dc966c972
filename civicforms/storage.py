"""Written intermediate tables in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Tables are written with
Spark's own Parquet writer, so it may lie in any store Spark knows, and every
executor can read them again after another one is lost.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="spark-civicforms-"))
    return _fallback[0]


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it takes it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def made(spark: SparkSession, path: str) -> str:
    """The path, a folder from now on, so that it can be read before anything was written to it."""
    system, target = file_system(spark, path)
    system.mkdirs(target)
    return path


class Workspace:
    """Written intermediate tables of one query.

    A lazily returned result may still read them, so they are removed when the
    driver ends; ``drop`` removes a table earlier when nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: dict[str, str] = {}
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, table: str, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.root}/{table}"
        writer = df.write.option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
        """A table dealt and sorted by ``key``, so that joins on it need not move it again."""
        name = f"t{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{table}")
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        self.names[table] = name
        return self.spark.table(name)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of phases whose results are written.

        The session holds on to its latest plan, so a trivial one is run first.
        """
        self.spark.range(1).collect()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        """Remove all tables, when no result that reads them is wanted any more."""
        for table in list(self.names):
            self.drop(table)
        self._remove(self.root)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def drop(self, table: str) -> None:
        if table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(table)}")
        self._remove(f"{self.root}/{table}")

    def _remove(self, path: str) -> None:
        try:
            system, target = file_system(self.spark, path)
            system.delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended already; a leftover folder is harmless
            pass
