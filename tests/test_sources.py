from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tenderlake.operators.windows import rate_eta
from tenderlake.sources import documents, sinks


def test_documents_and_keys(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "GEM-1.txt").write_text("one\ntwo")
    (tmp_path / "a" / "b" / "GEM-2.TXT.txt").write_text("three")
    rows = {r["doc_id"]: r["text"] for r in documents.read_documents(spark, str(tmp_path / "a")).collect()}
    assert rows == {"GEM-1": "one\ntwo", "GEM-2.TXT": "three"}
    (tmp_path / "keys").write_text(" 12 \n\nx7\n12\n 3\n")
    assert {r["key"] for r in documents.read_keys(spark, str(tmp_path / "keys")).collect()} == {"12", "x7", "3"}
    assert {r["key"] for r in documents.read_keys(spark, str(tmp_path / "keys"), numeric=True).collect()} == {12, 3}


def test_links(spark):
    rows = spark.createDataFrame([("1", '<a href=\\"https:\\/\\/x\\/y.pdf\\">'), ("1", "<b>"), ("0", '<a href="z">'), (None, "")], "status string, html string")
    assert [(r["url"], r["outcome"]) for r in documents.extract_links(rows).collect()] == [("https://x/y.pdf", "ok"), (None, "no_url"), (None, "bad_status"), (None, "bad_status")]


def test_section(spark):
    df = spark.createDataFrame([("a START b END c",), ("a START b",), ("none",), (None,)], "x string")
    assert [r["y"] for r in df.select(documents.section(F.col("x"), "START", "END").alias("y")).collect()] == ["b", " b", "", None]


def test_open_table_and_snapshot(spark, tmp_path):
    schema = StructType([StructField("k", LongType())])
    path = str(tmp_path / "t")
    assert sinks.open_table(spark, path, schema).count() == 0
    spark.range(3).withColumnRenamed("id", "k").write.parquet(path)
    assert sinks.open_table(spark, path, schema).count() == 3
    assert sinks.open_table(spark, path, schema, obsolete=("k",)).count() == 0
    assert sinks.open_table(spark, path, schema, reset=True).count() == 0
    assert sinks.snapshot(spark.range(0), str(tmp_path)) is None
    made = sinks.snapshot(spark.range(2), str(tmp_path), datetime(2024, 1, 2, 3, 4, 5))
    assert made.endswith("snapshot_ts=20240102_030405") and spark.read.parquet(made).count() == 2


def test_schema_drift(spark, tmp_path):
    ddl = StructType.fromDDL
    there = ddl("a int, b long, c decimal(8,2), d date, e string, f float, old int, same string, s short")
    want = ddl("a long, b int, c decimal(10,2), d timestamp_ntz, e int, f double, new string, same string, s decimal(6,1)")
    assert sinks.drift(there, want, ("old",)) == {"a": "widened", "b": "retyped", "c": "widened", "d": "widened", "e": "retyped", "f": "widened", "old": "obsolete", "new": "missing", "s": "widened"}
    assert sinks.drift(there, want)["old"] == "extra" and sinks.drift(want, want) == {}
    assert sinks.drift(ddl("c decimal(8,4)"), ddl("c decimal(10,2)")) == sinks.drift(ddl("c int"), ddl("c decimal(10,2)")) == {"c": "retyped"}
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x", 5)], "k int, extra string, n int").write.parquet(path)
    found = sinks.open_table(spark, path, ddl("k long, n int, more string"))
    assert found.schema == ddl("k long, n int, more string") and [tuple(r) for r in found.collect()] == [(1, 5, None)]
    assert sinks.open_table(spark, path, ddl("k string")).count() == 0
    assert sinks.read_snapshot(spark, str(tmp_path / "none")) is None


def test_export(spark, tmp_path):
    contracts = spark.createDataFrame([("C-1", None)], "ContractNo string, Buyer_GSTIN string")
    items = spark.createDataFrame([("C-1", 1, "pen")], "ContractNo string, ItemNo int, ProductName string")
    sinks.export_tables(contracts, items, str(tmp_path), "parquet")
    assert len(spark.read.parquet(str(tmp_path / "contracts")).columns) == 17
    row = spark.read.parquet(str(tmp_path / "items")).first()
    assert (row["ItemNo"], row["HSNCode"]) == ("1", "")


def test_star(spark, tmp_path):
    from tenderlake.plans.catalog import _star

    tables = _star(spark, "/root/testdata/sf0.001")
    sinks.write_star(tables, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "contracts")).count() == tables["contracts"].count()


def test_rate_of_one_sample(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), 1)], "run_id long, ts timestamp_ntz, pages int")
    row = rate_eta(df, total=5).first()
    assert (row["pages_per_s"], row["eta"]) == (0.0, "00:00:00")
