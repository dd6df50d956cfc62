"""Index shards and the rows that ask them, brought together without a join on the rows' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(index: DataFrame, asked: DataFrame, served: int, *spread: str) -> DataFrame:
    """(shard, salt, turn, index, asked): for each shard and task, its rows of index (turn 0), then the rows that ask it (turn 1).

    Both frames have a column shard. A shard is served by one task for each `served` rows, over which
    they are spread by the columns given; its index goes to each. Shards that nobody asks stay away.
    """
    tasks = asked.groupBy("shard").agg(F.ceil(F.count("*") / served).cast("int").alias("_tasks"))
    pack = lambda df: F.struct(*[F.col(c) for c in df.columns if c != "shard"])
    none = lambda df: F.lit(None).cast(df.select(pack(df).alias("x")).schema["x"].dataType)
    own = index.join(tasks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("salt"), F.lit(0).alias("turn"), pack(index).alias("index"), none(asked).alias("asked"))
    rows = asked.join(tasks, "shard").select("shard", F.pmod(F.xxhash64(*spread), F.col("_tasks")).cast("int").alias("salt"), F.lit(1).alias("turn"), none(index).alias("index"), pack(asked).alias("asked"))
    return own.union(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "turn")
