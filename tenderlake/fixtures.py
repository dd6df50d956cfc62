"""Procurement-shaped frames derived from the base tables: an observation log, a star, and rendered contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.windows import number_items

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bid log: an event is one sighting of its user's bid."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.floor(F.col("event_id") / 10) + 1).alias("page_num"),
        (F.col("event_id") % 10).cast("int").alias("pos"),
        F.col("user_id").alias("b_id"),
        F.concat(F.lit("B-"), "user_id").alias("b_bid_number"),
        F.col("event_type").alias("b_category_name"),
        F.floor("value").cast("int").alias("b_status"),
        F.col("ts").alias("final_end_date_sort"),
        F.concat(F.lit("D"), F.col("user_id") % 7).alias("department_name"),
        F.get_json_object("props", "$.k").cast("int").alias("b_total_quantity"),
    )


def pages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_num, body): the log as landed JSON pages. Each declares the distinct bids of the log; odd events write lists, every 97th document has only `id`, every 50th page is an error."""
    log = observations(spark, sf_dir)
    total = log.agg(F.countDistinct("b_id")).first()[0]
    kinds = {"b_bid_number": "string", "b_category_name": "string", "b_status": "int", "department_name": "string", "b_total_quantity": "int"}
    listed = F.to_json(F.struct(F.col("b_id").cast("string").alias("id"), F.array(F.when(F.col("seq") % 97 == 0, F.lit(0)).otherwise(F.col("b_id"))).alias("b_id"), *[F.array(c).alias(c) for c in kinds], F.array(F.date_format("final_end_date_sort", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("final_end_date_sort")))
    plain = F.to_json(F.struct(F.col("b_id").cast("string").alias("id"), F.when(F.col("seq") % 97 == 0, F.lit(0)).otherwise(F.col("b_id")).alias("b_id"), *kinds, F.date_format("final_end_date_sort", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("final_end_date_sort")))
    doc = F.when(F.col("seq") % 2 == 1, listed).otherwise(plain)
    docs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", doc.alias("doc")))), lambda x: x["doc"]), ",")
    body = F.concat(F.lit('{"response":{"response":{"numFound":'), F.lit(str(total)), F.lit(',"docs":['), docs, F.lit("]}}}"))
    return log.groupBy("page_num").agg(body.alias("body")).withColumn("body", F.when(F.col("page_num") % 50 == 0, F.lit('{"error":1}')).otherwise(F.col("body")))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part, numbered in each order. Parts come first: what is gathered by order after that, and joined with orders by their key, needs no other shuffle of the items."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return number_items(table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", *ITEM_ORDER)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select(
        F.concat(F.lit("C-"), "l_orderkey").alias("contract_number"),
        "item_no",
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("model"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        "l_suppkey",
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a contract, with its organisation, buyer and seller (of item 1) in line."""
    return _contracts(spark, sf_dir, _numbered(spark, sf_dir).where("item_no = 1").select("l_orderkey", "l_suppkey"))


def _contracts(spark: SparkSession, sf_dir: str, of_order: DataFrame) -> DataFrame:
    """contracts, from a row for each order with items (l_orderkey, l_suppkey of item 1), whose further columns are kept."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(of_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select(
        F.concat(F.lit("C-"), "o_orderkey").alias("contract_number"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("contract_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_value"),
        F.col("n_name").alias("org_name"),
        F.col("o_orderstatus").alias("org_type"),
        F.col("r_name").alias("ministry"),
        F.concat(F.lit("c"), "c_custkey", F.lit("@buyer.test")).alias("buyer_email"),
        F.col("o_orderpriority").alias("buyer_designation"),
        F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("buyer_contact"),
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("seller_id"),
        F.concat("s_name", F.lit("/"), "o_orderstatus").alias("company_name"),
        *[c for c in of_order.columns if c not in ("l_orderkey", "l_suppkey")],
    )


def _amount(c) -> F.Column:
    return F.format_number(c, 2)


def contract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each contract rendered, a field a line but for the brand's type, bilingual labels and thousands separators."""
    no, price = F.col("item_no"), _amount(F.col("l_extendedprice").cast("decimal(18,2)"))
    item = F.concat(F.lit("Product Name : "), "p_name", F.lit("\nBrand : "), "p_brand", F.lit(" Brand Type : Registered\nश्रेणी|Category Name & Quadrant : Q"), (no % 4).cast("string"), F.when(no % 2 == 1, F.lit("\nCatalogue Status : OEM verified\nSelling As : Reseller not verified by OEMs\nHSN Code : 9608")).otherwise(F.lit("")), F.lit("\nModel : "), "p_type", F.lit("\n"), F.col("l_quantity").cast("int").cast("string"), F.lit(" pieces "), "price", F.lit(" NA "), "price")
    each = _numbered(spark, sf_dir).withColumn("price", price).select("l_orderkey", F.when(no == 1, F.col("l_suppkey")).alias("l_suppkey"), F.struct("item_no", item.alias("item")).alias("item"))
    listed = each.groupBy("l_orderkey").agg(F.max("l_suppkey").alias("l_suppkey"), F.array_join(F.sort_array(F.collect_list("item"))["item"], "\n").alias("items"))
    line = lambda label, value: F.concat(F.lit(f"{label} : "), value)
    return _contracts(spark, sf_dir, listed).select(
        F.col("contract_number").alias("doc_id"),
        F.concat_ws(
            "\n",
            line("अनुबंध|Contract No", F.col("contract_number")),
            F.concat(line("Generated Date", F.date_format("contract_date", "d-MMM-yyyy")), F.lit(" (cid:12)")),
            F.lit("Buyer Details"),
            line("Designation", F.col("buyer_designation")),
            line("Contact No.", F.col("buyer_contact")),
            line("ईमेल|Email ID", F.col("buyer_email")),
            F.lit("Seller Details"),
            line("GeM Seller ID", F.col("seller_id")),
            line("Company Name", F.col("company_name")),
            F.col("items"),
            F.concat(F.lit("Total Order Value (in INR) "), _amount(F.col("total_value"))),
        ).alias("text"),
    )


def contract_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, table_no, row_no, col_no, cell_text): buyer and seller blocks as cells, and a total row."""
    row = lambda r, c, text: F.struct(F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), text.alias("cell_text"))
    buyer = F.concat(F.lit("Buyer Details\nDesignation : "), "buyer_designation", F.lit("\nContact No. : "), "buyer_contact", F.lit("\nEmail ID : "), "buyer_email", F.lit("\nleaked street\nAddress : Ward "), F.col("seq") % 9)
    seller = F.concat(F.lit("Seller Details\nGeM Seller ID : "), "seller_id", F.lit("\nCompany Name : "), "company_name", F.lit("\nContact No. : 98"), F.lpad(F.col("seq").cast("string"), 8, "0"), F.lit(", 97"), F.lpad(F.col("seq").cast("string"), 8, "0"), F.lit(", 98"), F.lpad(F.col("seq").cast("string"), 8, "0"))
    again = F.when(F.col("seq") % 10 == 0, F.concat(F.lit("Seller Details\nCompany Name : again "), "company_name"))
    cells = F.array(row(1, 1, buyer), row(2, 1, seller), row(3, 1, again), row(4, 1, F.lit("Total Order Value (in INR)")), row(4, 2, _amount(F.col("total_value"))))
    return contracts(spark, sf_dir).select(F.col("contract_number").alias("doc_id"), F.explode(cells).alias("c")).select("doc_id", "c.*").where("cell_text is not null")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, ts, event_id, pages): a cumulative count for each user."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("run_id"), "ts", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pages"))
