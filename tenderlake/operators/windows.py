"""Running numbers, first sightings and moving rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_items(items: DataFrame, doc: str, *order: str) -> DataFrame:
    """Numbers from 1 in each document, by order of appearance."""
    return items.withColumn("item_no", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def flag_inserts(log: DataFrame, key: str, seq: str) -> DataFrame:
    """is_insert: the first row of its key by seq; rows that tie for it all are. A minimum is gathered for each key first and joined back, a join that Spark splits where a key is frequent."""
    first = log.groupBy(F.col(key).alias("_key")).agg(F.min(seq).alias("_first"))
    return log.join(first, F.col(key).eqNullSafe(F.col("_key"))).select(*log.columns, (F.col(seq) == F.col("_first")).alias("is_insert"))


#: Samples of a run that a task orders, about; a longer run is cut into parts of time.
PART_ROWS = 100_000


def _parts(samples: DataFrame, run: str, seconds: int, part_rows: int) -> DataFrame:
    """samples with _t (microseconds), _first (of its run), _part, and _halo: rows of the last `seconds` of a part stand in the next one too, marked, so each row's past lies in its part."""
    timed = samples.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    span = F.max("_t") - F.min("_t")
    # a part is as long as part_rows samples are at the run's mean rate, and no shorter than the halo
    width = F.greatest(F.lit(seconds * 1_000_000), F.ceil(span / F.count("*") * part_rows))
    runs = timed.groupBy(F.col(run).alias("_run")).agg(F.min("_t").alias("_first"), F.coalesce(width, F.lit(seconds * 1_000_000)).alias("_width"))
    # Spark splits this join where a run is long
    known = timed.join(runs, F.col(run).eqNullSafe(F.col("_run")))
    part = F.floor((F.col("_t") - F.col("_first")) / F.col("_width"))
    ahead = F.floor((F.col("_t") + seconds * 1_000_000 - F.col("_first")) / F.col("_width"))
    copies = F.when(ahead > part, F.array(F.struct(part.alias("_part"), F.lit(False).alias("_halo")), F.struct(ahead.alias("_part"), F.lit(True).alias("_halo")))).otherwise(F.array(F.struct(part.alias("_part"), F.lit(False).alias("_halo"))))
    return known.select(*[F.col(f"`{c}`") for c in samples.columns], "_t", "_first", F.inline(copies))


def rate_eta(samples: DataFrame, total: int, run: str = "run_id", seconds: int = 10, per_page: int = 10, part_rows: int = PART_ROWS) -> DataFrame:
    """For each sample (run, ts, pages): pages a second over the last `seconds`, the overall average where these hold one sample, records a second, and the time left as HH:MM:SS. A sample without a time has rate 0. A long run is cut into parts of time that tasks take apart."""
    timed = _parts(samples, run, seconds, part_rows)
    recent = Window.partitionBy(run, "_part").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    span = (F.max("_t").over(recent) - F.min("_t").over(recent)) / 1e6
    moved = F.max("pages").over(recent) - F.min("pages").over(recent)
    age = (F.col("_t") - F.col("_first")) / 1e6
    rate = F.when(span > 0, moved / span).when(age > 0, F.col("pages") / age).otherwise(0.0)
    rated = timed.withColumn("pages_per_s", F.round(rate, 6)).where("not _halo")
    left = F.when(F.col("pages_per_s") > 0, F.floor(F.greatest(F.lit(total) - F.col("pages"), F.lit(0)) / F.col("pages_per_s"))).otherwise(F.lit(0)).cast("long")
    clock = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(left / 3600)
    eta = F.concat_ws(":", F.when(hours < 100, clock(hours)).otherwise(hours.cast("string")), clock(F.floor(left / 60) % 60), clock(left % 60))
    return rated.select(*samples.columns, "pages_per_s", F.round(F.col("pages_per_s") * per_page, 5).alias("records_per_s"), eta.alias("eta"))
