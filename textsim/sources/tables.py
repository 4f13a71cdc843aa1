"""Parquet table access for the driver's test tables (and any same-shaped data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table, projecting ``columns`` so the scan's ReadSchema is pruned."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a text table over the cores when the scan yields fewer splits.

    Large inputs arrive in many file splits and are left as they are; a small
    file with one row group would otherwise run its regex work in one task.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
