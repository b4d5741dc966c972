"""A keyed table that patches are merged into, version by version (K4).

Rows lie in buckets by a hash of their key.  A merge reads and rewrites only the buckets that its
patches touch, into a folder of the new version.  Which version each bucket has is said by a
manifest, a small file that is written last and put in place by one rename.  Readers follow the
latest manifest, so they see all of a merge or nothing of it, and go on reading theirs while
a merge runs.  A merge that stopped half way leaves folders that no manifest names; the
next one writes over them.  A merge carries a number, and one that is done is not done
again, which makes it fit for ``foreachBatch``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civicforms.sources.sinks import keyed_merge
from civicforms.storage import file_system, made

BUCKETS = 64
BUCKET = "__bucket"


class KeyedStore:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema
        made(spark, f"{self.root}/manifests")
        #: A store keeps the number of buckets it was made with.
        self.buckets = self.manifest().get("buckets", buckets)

    def manifest(self) -> dict:
        """The latest: version, number of buckets, version of each bucket that has rows, number of the last merge of each writer."""
        system, folder = file_system(self.spark, f"{self.root}/manifests")
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())
        if not versions:
            return {}
        text = self.spark.read.text(f"{self.root}/manifests/{versions[-1]:012}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        system, target = file_system(self.spark, f"{self.root}/manifests/{manifest['version']:012}.json")
        _, draft = file_system(self.spark, f"{self.root}/manifests/_{manifest['version']:012}")
        stream = system.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not system.rename(draft, target):
            raise RuntimeError(f"version {manifest['version']} is there already: another writer is at work")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _load(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        named = {int(b): v for b, v in manifest.get("versions", {}).items() if buckets is None or int(b) in buckets}
        paths = [f"{self.root}/data/version={v}/{BUCKET}={b}" for b, v in sorted(named.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows as of the latest merge."""
        return self._load(self.manifest())

    def lookup(self, value: object) -> DataFrame:
        """The row of one key, from its bucket alone."""
        kind = self.read().schema[self.key].dataType
        one = self.spark.range(1).select(F.lit(value).cast(kind).alias(self.key))
        bucket = one.select(self._bucket()).first()[0]
        return self._load(self.manifest(), {bucket}).where(F.col(self.key).eqNullSafe(F.lit(value)))

    def merge(self, patches: DataFrame, number: int | None = None, writer: str = "", order: str | None = None) -> bool:
        """Lay the non-null columns of patches over the rows of their keys; unknown keys are added, rows without a key left out.

        Of several patches of a key the last by ``order`` counts for each column (without it, the greatest value).  Returns
        whether anything was done: a merge whose ``number`` is not above the writer's last one was done before.
        """
        old = self.manifest()
        done = old.get("merged", {})
        if number is not None and number <= done.get(writer, -1):
            return False
        version = old.get("version", -1) + 1
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns if c in patches.columns and c != self.key]
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)
        one = patches.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*[last(c).alias(c) for c in columns] or [F.count(F.lit(1)).alias("__n")]).drop("__n")
        path = f"{self.root}/patches/version={version}"
        one.withColumn(BUCKET, self._bucket()).write.mode("overwrite").parquet(path)
        one = self.spark.read.parquet(path)
        touched = {r[0] for r in one.select(BUCKET).distinct().collect()}  # as many numbers as there are buckets, at most
        if touched:
            there = self._load(old, touched)
            merged = keyed_merge(there, one.drop(BUCKET), self.key).withColumn(BUCKET, self._bucket())
            merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/data/version={version}")
        versions = old.get("versions", {}) | {str(b): version for b in sorted(touched)}
        merged_by = done if number is None else done | {writer: number}
        self._publish({"version": version, "buckets": self.buckets, "versions": versions, "merged": merged_by})
        return True

    def follow(self, patches: DataFrame, checkpoint: str, order: str | None = None) -> StreamingQuery:
        """Merge what is there of a stream of patches; each batch once, also if it is repeated after a failure."""
        merge = lambda batch, number: self.merge(batch, number, checkpoint, order)
        return patches.writeStream.foreachBatch(lambda batch, number: merge(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def clean(self, keep: int = 2) -> None:
        """Remove the data of buckets that none of the latest manifests names; readers of older ones must be done."""
        system, folder = file_system(self.spark, f"{self.root}/manifests")
        names = sorted(f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName()[0].isdigit())
        used = set()
        for name in names[-keep:]:
            manifest = json.loads(self.spark.read.text(f"{self.root}/manifests/{name}", wholetext=True).first()[0])
            used |= {(v, int(b)) for b, v in manifest["versions"].items()}
        for name in names[:-keep]:
            system.delete(file_system(self.spark, f"{self.root}/manifests/{name}")[1], False)
            version = int(name.removesuffix(".json"))
            for b in range(self.buckets):
                if (version, b) not in used:
                    system.delete(file_system(self.spark, f"{self.root}/data/version={version}/{BUCKET}={b}")[1], True)
            system.delete(file_system(self.spark, f"{self.root}/patches/version={version}")[1], True)
