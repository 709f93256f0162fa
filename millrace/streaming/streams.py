"""The operators that go on with a stream: first copies, lane counts, ledger appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.ledger import CONSUMPTION, append_numbered
from millrace.session import shared_folder

_PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path)


def first_copies(stream: DataFrame, text_col: str = "text", time_col: str = "ingested_at", delay: str | None = None) -> DataFrame:
    """Rows of a stream whose text was not met before, whatever their order and files; each text's hash stays in the state.

    With a ``delay`` the state is bounded at the cost of rows: those later than
    the watermark are lost, and copies that come after the delay pass again.
    """
    hashed = stream.withColumn("_h", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    first = hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_h"]) if delay else hashed.dropDuplicates(["_h"])
    return first.drop("_h")


def lane_counts(stream: DataFrame, lane_col: str, time_col: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Rows of each lane in each window of event time; rows later than the delay are not counted."""
    counted = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), F.col(lane_col).alias("lane")).agg(F.count("*").alias("served"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "lane", "served")


def append_stream(spark: SparkSession, stream: DataFrame, ledger: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """Each batch of a stream appended to a ledger, exactly once.

    A batch has a folder of its own, named by its number, and its ids go on from
    the batches before it; a batch that comes again after a crash replaces its
    own rows by the same ones.
    """

    def write(batch: DataFrame, number: int) -> None:
        try:
            held = spark.read.schema(T.StructType([*CONSUMPTION.fields, T.StructField("batch", T.LongType())])).parquet(ledger).where(F.col("batch") < number)
            held.limit(1).count()
        except Exception as problem:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            held = spark.createDataFrame([], CONSUMPTION)
        rows = append_numbered(held, batch, order)
        rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CONSUMPTION])
        rows.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(frame: DataFrame, name: str) -> DataFrame:
    """All available rows of a stream through to files in the shared folder, read as a table; the driver holds none of them.

    The state is kept in RocksDB, beside the heap, as it may hold a hash of every text.
    """
    spark = frame.sparkSession
    place = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER_SETTING)
    spark.conf.set(_PROVIDER_SETTING, _ROCKSDB)
    try:
        # A query takes the session's settings when it starts.
        query = frame.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER_SETTING, before)
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{place}/rows")


def counted_table(frame: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """A stream of updated rows through to files in the shared folder: of each of ``keys`` the row of its last batch. The driver holds none of them."""
    spark = frame.sparkSession
    place = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    frame.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*frame.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{place}/rows")
    others = [c for c in frame.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])
