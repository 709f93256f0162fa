"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``, pruned to ``columns`` if any are given.

    Naming the columns keeps the scan's ReadSchema narrow even where a Python
    operator follows, which Catalyst cannot look into.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has slots.

    A table of a cluster's size already has more input splits than slots and is
    returned as it is, without a shuffle. A small table in one file would keep
    a single core busy with the Python operator that follows, so its rows are
    dealt out once. No row is added or left out either way.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, by) if by else df.repartition(slots)
