"""Dates as DD-MM-YYYY text and as timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "dd-MM-yyyy"


def parse_day(c: Column) -> Column:
    """Null where the text isn't a day."""
    return F.when(is_day(c), F.try_to_timestamp(c, F.lit(DAY)).cast("date"))


def show_day(c: Column) -> Column:
    return F.date_format(c, DAY)


def is_day(c: Column) -> Column:
    return c.rlike(r"^\d{2}-\d{2}-\d{4}$") & F.try_to_timestamp(c, F.lit(DAY)).isNotNull()


def shift_day(c: Column, months: int = 0, days: int = 0) -> Column:
    """Months first, clamped to the month's end, then days."""
    return F.date_add(F.add_months(c, months), days)


def contract_time(c: Column) -> Column:
    """From DD/MM/YYYY HH:MM; null for other text."""
    return F.try_to_timestamp(c, F.lit("dd/MM/yyyy HH:mm")).cast("timestamp_ntz")


def date_windows(spark: SparkSession, first_from: str, first_to: str, today: str) -> DataFrame:
    """(n, from_day, to_day): windows that follow each other up to today, each start a day after the last end, each end three months less a day on, clamped to today. Days are ISO text."""
    days = spark.range(1).select(*[F.lit(x).cast("date").alias(c) for c, x in (("first", first_from), ("end", first_to), ("today", today))])
    second = F.date_add("end", 1)
    later = F.greatest(F.ceil(F.months_between("today", second) / 3).cast("int"), F.lit(0)) + 1
    # each start is three months after the one before, its day clamped again and again
    starts = F.aggregate(F.sequence(F.lit(1), later), F.array("first", second), lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), 3))))
    spans = days.select("today", starts.alias("starts")).select("today", F.posexplode("starts").alias("n", "from_day"), "starts")
    to_day = F.coalesce(F.date_add(F.get("starts", F.col("n") + 1), -1), F.col("today"))
    return spans.where("from_day <= today").select((F.col("n") + 1).alias("n"), "from_day", F.least(to_day, F.col("today")).alias("to_day"))
