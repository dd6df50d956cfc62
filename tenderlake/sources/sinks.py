"""Tables as they leave the engine."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StructType

from ..operators.rows import conform, stringify
from ..schemas import CONTRACT_COLUMNS, ITEM_COLUMNS
from . import commits


def export_tables(contracts: DataFrame, items: DataFrame, path: str, form: str = "csv") -> None:
    """Contracts and items with their fixed columns, all as text, in two folders."""
    for name, df, columns in (("contracts", contracts, CONTRACT_COLUMNS), ("items", items, ITEM_COLUMNS)):
        stringify(conform(df, columns), columns).write.format(form).option("header", True).mode("overwrite").save(f"{path}/{name}")


def write_star(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet; contracts by year."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name == "contracts":
            writer = df.withColumn("year", F.year("contract_date")).write.mode("overwrite").partitionBy("year")
        writer.parquet(f"{path}/{name}")


#: A type and those that hold all its values.
WIDER = {
    "tinyint": ["smallint", "int", "bigint", "float", "double"],
    "smallint": ["int", "bigint", "float", "double"],
    "int": ["bigint", "double"],
    "float": ["double"],
    "date": ["timestamp_ntz", "timestamp"],
}
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def _widens(old: DataType, new: DataType) -> bool:
    """Whether each value of the old type is one of the new."""
    if new.simpleString() in WIDER.get(old.simpleString(), []):
        return True
    if isinstance(new, DecimalType):
        whole = new.precision - new.scale
        if isinstance(old, DecimalType):
            return whole >= old.precision - old.scale and new.scale >= old.scale
        return old.simpleString() in _DIGITS and whole >= _DIGITS[old.simpleString()]
    return False


def drift(there: StructType, expected: StructType, obsolete: tuple[str, ...] = ()) -> dict[str, str]:
    """Column -> how a stored schema differs from the expected one: obsolete, missing, widened (all stored values are values of the expected type), retyped (they aren't) or extra."""
    old, new = ({f.name: f.dataType for f in s} for s in (there, expected))
    found = {c: "obsolete" if c in obsolete else "extra" for c in old if c in obsolete or c not in new}
    for c, kind in new.items():
        if c not in old:
            found[c] = "missing"
        elif c not in found and old[c] != kind:
            found[c] = "widened" if _widens(old[c], kind) else "retyped"
    return found


def open_table(spark: SparkSession, path: str, schema: StructType, obsolete: tuple[str, ...] = (), reset: bool = False) -> DataFrame:
    """The table at path in the schema's columns and types: missing columns are null, narrower ones cast, extra ones left out. An empty one if there is none, if it has an obsolete column or one of a type that the schema's can't hold, or if a reset is asked for."""
    empty = spark.createDataFrame([], schema)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if reset or not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    there = spark.read.parquet(path)
    differs = drift(there.schema, schema, obsolete)
    if {"obsolete", "retyped"} & set(differs.values()):
        return empty
    return there.select(*[(F.lit(None) if differs.get(f.name) == "missing" else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema])


def snapshot(df: DataFrame, root: str, at: datetime | None = None) -> str | None:
    """Write a non-empty table under a name with the time, and commit it (sources.commits); the folder, or None."""
    if df.isEmpty():
        return None
    spark, stamp = df.sparkSession, (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    path = f"{root}/snapshot_ts={stamp}"
    df.write.mode("overwrite").parquet(path)
    while not commits.publish(spark, root, (commits.versions(spark, root) or [0])[-1] + 1, {"snapshot": stamp, "schema": df.schema.jsonValue()}):
        pass  # another snapshot took the number
    return path


def read_snapshot(spark: SparkSession, root: str, at: datetime | None = None) -> DataFrame | None:
    """The last whole snapshot, or the last one of that time or before; None without any."""
    there = [commits.content(spark, root, v) for v in commits.versions(spark, root)]
    until = at.strftime("%Y%m%d_%H%M%S") if at else "9"
    fit = [x for x in there if x["snapshot"] <= until]
    if not fit:
        return None
    last = max(reversed(fit), key=lambda x: x["snapshot"])
    return spark.read.schema(StructType.fromJson(last["schema"])).parquet(f"{root}/snapshot_ts={last['snapshot']}")
