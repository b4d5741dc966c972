"""What the stateful streams share: their state store, arrival times and numbered parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicforms.storage import made

#: When a row arrived.  It is the event time of timers and watermarks, so that no row is ever too late.
ARRIVED = "__arrived"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving(rows: DataFrame, lag: float = 0.0) -> DataFrame:
    """Rows of a stream with the time of their batch; the watermark lags ``lag`` seconds behind it."""
    return rows.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, f"{round(lag * 1000)} milliseconds")


def run_to_parts(rows: DataFrame, path: str, after: Callable[[DataFrame, int], None] | None = None, mode: str = "update") -> None:
    """Consume what is there of a stream; each batch is one numbered part that replaces itself when it is repeated."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after is not None:
            after(spark.read.schema(rows.schema).parquet(f"{path}/batch={number}"), number)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def read_parts(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """All parts written so far, with the number of their batch; none if there is none."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(made(spark, path))
