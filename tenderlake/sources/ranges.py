"""Tables in files of sorted ranges, with a list of the ranges, so that a lookup opens the files of its values only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ranges(df: DataFrame, path: str, column: str, *then: str, files: int | None = None, **options: str) -> None:
    """df sorted by the columns, a range a file; path/files tells the least and greatest value of each."""
    by = [column, *then]
    ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.options(**options).parquet(f"{path}/data")
    spark = df.sparkSession
    written = spark.read.schema(df.schema).parquet(f"{path}/data")
    ends = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))
    ends.coalesce(1).write.parquet(f"{path}/files")


def files_of(spark: SparkSession, path: str, values: list) -> list[str]:
    """The files whose range has one of the values."""
    ends = spark.read.parquet(f"{path}/files")
    wanted = F.array(*[F.lit(v).cast(ends.schema["low"].dataType) for v in values])
    near = ends.where(F.exists(wanted, lambda v: v.between(F.col("low"), F.col("high"))))
    return sorted(f"{path}/data/{r['file']}" for r in near.select("file").collect())


def read_values(spark: SparkSession, path: str, column: str, values: list) -> DataFrame:
    """Rows whose column is one of the values."""
    schema = spark.read.parquet(f"{path}/data").schema
    files = files_of(spark, path, values) if values else []
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).where(F.col(column).isin(values))


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")
