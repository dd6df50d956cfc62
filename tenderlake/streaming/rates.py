"""Live rates of a stream of events, with late ones kept apart.

Each batch is a commit (sources.commits). The watermark of a batch is the latest time of the batches
before it less `late`: events before it are late and go to a table of their own, the others are
counted into the windows that they lie in, which are all open. Windows that end by the watermark after
a batch are closed: appended to the result, and gone from the state, which so holds the windows of
`late` and ten seconds at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import commits
from .ingest import rate_by_window

_WINDOWS = "start timestamp, n long"


def _read(spark: SparkSession, root: str, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


def _said(spark: SparkSession, root: str) -> dict:
    return commits.content(spark, root) or {"batch": -1, "latest": None, "open": [], "closed": [], "late": []}


def closed_windows(spark: SparkSession, root: str) -> DataFrame:
    """(start, n): windows that no event can change any more."""
    return _read(spark, root, _said(spark, root)["closed"], _WINDOWS)


def open_windows(spark: SparkSession, root: str) -> DataFrame:
    """(start, n): the state."""
    return _read(spark, root, _said(spark, root)["open"], _WINDOWS)


def late_events(spark: SparkSession, root: str) -> DataFrame:
    """(ts, v): events that came too late for their windows, and the batch that had them."""
    return _read(spark, root, _said(spark, root)["late"], "ts timestamp, v long")


def fold_rates(events: DataFrame, batch_id: int, root: str, late: int) -> None:
    """Count a batch (ts), unless it has been."""
    spark = events.sparkSession
    said = _said(spark, root)
    if said["batch"] >= batch_id:
        return
    name = f"v={batch_id}-{uuid.uuid4().hex}"
    timed = events.where("ts is not null").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    # no watermark before the first event
    mark = said["latest"] - late * 1_000_000 if said["latest"] is not None else None
    is_late = F.lit(False) if mark is None else F.col("t") < mark
    timed.withColumns({"late": is_late, "ts": F.timestamp_micros("t"), "v": F.lit(batch_id).cast("long")}).write.partitionBy("late").parquet(f"{root}/{name}/events")
    rows = spark.read.schema("t long, ts timestamp, v long, late boolean").parquet(f"{root}/{name}/events")
    ends = rows.agg(F.max("t").alias("latest"), F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("fresh")).first()
    latest = max((x for x in (said["latest"], ends["latest"]) if x is not None), default=None)
    counted = rate_by_window(rows.where("not late").select("ts")).unionByName(open_windows(spark, root)).groupBy("start").agg(F.sum("n").alias("n"))
    over = F.unix_micros(F.col("start")) + 10_000_000 <= (latest - late * 1_000_000 if latest is not None else 0)
    counted.withColumn("over", over.cast("int")).write.partitionBy("over").parquet(f"{root}/{name}/windows")
    there = {r["over"] for r in spark.read.parquet(f"{root}/{name}/windows").select("over").distinct().collect()} if ends["fresh"] or said["open"] else set()
    entry = {
        "batch": batch_id,
        "latest": latest,
        "open": [f"{name}/windows/over=0"] if 0 in there else [],
        "closed": [*said["closed"], *([f"{name}/windows/over=1"] if 1 in there else [])],
        "late": [*said["late"], *([f"{name}/events/late=true"] if ends["late"] else [])],
    }
    if not commits.publish(spark, root, (commits.versions(spark, root) or [0])[-1] + 1, entry):
        raise RuntimeError("another stream writes these rates")


def stream_rates(events: DataFrame, root: str, checkpoint: str, late: int = 30) -> StreamingQuery:
    """Count a stream of events (ts) by windows of ten seconds that begin every second; late: seconds."""
    return events.writeStream.foreachBatch(lambda batch, batch_id: fold_rates(batch, batch_id, root, late)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
