"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_dir, shared_dir

__all__ = ["shared_dir", "staged"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
