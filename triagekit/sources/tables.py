"""Table sources: the parquet tables a deployment lands, read with pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst pushes later filters and projections into it."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
