"""Bid pages as a stream.

The state lies in buckets by a hash of the key. Each batch is a commit (sources.commits) that names the
folder of every bucket, their number, the schema, the last batch folded and the folders of landed pages:
readers see a batch whole or not at all, a batch that is replayed after its commit does nothing, and one
that is replayed before it starts from the state before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.folds import upsert
from ..sources import commits
from ..sources.pages import documents_of, flatten_bids

LAST_WINS = ("b_status", "final_end_date_sort")
#: Parts of the state by a hash of the key; a batch rewrites those that it touches.
BUCKETS = 64
#: Versions that stay readable.
KEEP = 10


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, state_dir: str, said: dict, buckets: list[int] | None) -> DataFrame | None:
    paths = [f"{state_dir}/{path}" for b, path in sorted(said["folders"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(StructType.fromJson(said["schema"])).parquet(*paths) if paths else None


def read_state(spark: SparkSession, state_dir: str, version: int | None = None, batch: int | None = None) -> DataFrame | None:
    """The state of a version, or as it was after a batch, or now; None where there is none."""
    if batch is not None:
        fit = [v for v in commits.versions(spark, state_dir) if commits.content(spark, state_dir, v)["batch"] <= batch]
        if not fit:
            return None
        version = fit[-1]
    said = commits.content(spark, state_dir, version)
    return _folders(spark, state_dir, said, None) if said else None


def read_pages(spark: SparkSession, state_dir: str) -> DataFrame:
    """(page_num, ok, value, v): the pages that were read, by batch v; value has what couldn't be used: lines that don't parse, pages without documents."""
    said = commits.content(spark, state_dir)
    paths = [f"{state_dir}/{p}" for p in (said["pages"] if said else [])]
    shape = "page_num long, ok boolean, value string, v long, pos int"
    rows = spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
    return rows.where("pos is null or pos = 0").drop("pos")


def _retire(spark: SparkSession, state_dir: str, keep: int) -> None:
    """Forget all but the last `keep` versions, and delete the folders that only they named."""
    there = commits.versions(spark, state_dir)
    names = lambda said: {*said["folders"].values(), *said["pages"]}
    used = {x for v in there[-keep:] for x in names(commits.content(spark, state_dir, v))}
    for v in there[:-keep]:
        for path in names(commits.content(spark, state_dir, v)) - used:
            commits.delete(spark, f"{state_dir}/{path}")
        commits.delete(spark, f"{state_dir}/commits/{v:012}.json")


def fold_batch(pages: DataFrame, batch_id: int, state_dir: str, buckets: int = BUCKETS, keep: int = KEEP) -> None:
    """Fold pages (value, page_num, body) into the state as that batch, if it hasn't been. Another number of buckets than the state has deals the whole state anew."""
    spark = pages.sparkSession
    said = commits.content(spark, state_dir)
    if said and said["batch"] >= batch_id:
        return
    landed = f"pages/v={batch_id}-{uuid.uuid4().hex}"
    # parsed once, and written: a row for each document, or for a page without any
    parsed = pages.select("page_num", "value", documents_of().alias("docs"))
    ok = F.col("docs").isNotNull()
    # told of the page before its documents are dealt out: beside the explode it would be parsed again for each of them
    told = parsed.select("page_num", ok.alias("ok"), F.when(~ok, F.col("value")).alias("value"), F.lit(batch_id).cast("long").alias("v"), "docs")
    each = told.select("page_num", "ok", "value", "v", F.posexplode_outer("docs").alias("pos", "doc"))
    flat = flatten_bids(each, "ok", "value", "v").withColumn("bucket", F.when(F.col("b_id").isNotNull(), bucket_of(F.col("b_id"), buckets)))
    flat.write.parquet(f"{state_dir}/{landed}")
    rows = spark.read.schema(flat.schema).parquet(f"{state_dir}/{landed}").where("b_id is not null")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # `buckets` rows at most
    new = rows.withColumn("seq", F.struct(F.col("v").alias("batch"), "page_num", "pos")).drop("ok", "value", "v", "page_num", "pos", "bucket")
    anew = said is not None and said["buckets"] != buckets
    folders = dict(said["folders"]) if said and not anew else {}
    schema = said["schema"] if said else None
    if touched or anew:
        state = _folders(spark, state_dir, said, None if anew else touched) if said and said["folders"] else None
        earlier = F.struct(F.lit(-1).cast("long").alias("batch"), F.lit(0).cast("long").alias("page_num"), F.lit(0).alias("pos"))
        log = new if state is None else state.withColumn("seq", earlier).unionByName(new)
        folded = upsert(log, "b_id", "seq", LAST_WINS)
        path = f"v={batch_id}-{uuid.uuid4().hex}"
        folded.withColumn("bucket", bucket_of(F.col("b_id"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{state_dir}/{path}")
        there = range(buckets) if anew else touched
        if anew:
            there = [r["bucket"] for r in spark.read.parquet(f"{state_dir}/{path}").select("bucket").distinct().collect()]  # `buckets` rows at most
        folders |= {str(b): f"{path}/bucket={b}" for b in there}
        schema = folded.schema.jsonValue()
    while True:
        versions = commits.versions(spark, state_dir)
        now = commits.content(spark, state_dir)  # pages may have been put together meanwhile
        if commits.publish(spark, state_dir, (versions or [0])[-1] + 1, {"batch": batch_id, "buckets": buckets, "schema": schema, "folders": folders, "pages": [*(now["pages"] if now else []), landed]}):
            break
    _retire(spark, state_dir, keep)


def compact_pages(spark: SparkSession, state_dir: str) -> int | None:
    """Put the landed pages of all batches into one folder, a row a page; the new version. The stream may go on meanwhile."""
    said = commits.content(spark, state_dir)
    if not said or len(said["pages"]) < 2:
        return None
    path = f"pages/all-{uuid.uuid4().hex}"
    rows = spark.read.parquet(*[f"{state_dir}/{p}" for p in said["pages"]]).where("pos is null or pos = 0").select("page_num", "ok", "value", "v", F.lit(None).cast("int").alias("pos"))
    rows.write.parquet(f"{state_dir}/{path}")
    while True:
        version, now = commits.versions(spark, state_dir)[-1], commits.content(spark, state_dir)
        rest = [p for p in now["pages"] if p not in said["pages"]]
        if commits.publish(spark, state_dir, version + 1, {**now, "pages": [path, *rest]}):
            return version + 1


def stream_upsert(spark: SparkSession, in_dir: str, state_dir: str, checkpoint: str, max_files: int = 1000, buckets: int = BUCKETS, keep: int = KEEP) -> StreamingQuery:
    """Fold landed pages into the state, a version a batch. Files hold a JSON object (page_num, body) a line, body being the page as it came. Pages that were read, and lines that can't be used, are kept (`read_pages`)."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(in_dir)
    pages = lines.select("value", F.from_json("value", "page_num long, body string").alias("p")).select("value", "p.*")
    fold = lambda batch, batch_id: fold_batch(batch, batch_id, state_dir, buckets, keep)
    return pages.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_by_window(events: DataFrame, late: str = "30 seconds") -> DataFrame:
    """(start, n): events in ten-second windows that begin every second; for streams and tables alike."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "10 seconds", "1 second")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
