"""Every operator as a query over a folder of tables, with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fixtures as fx
from ..functions import dates as d
from ..functions import text as t
from ..functions.variant import first_or
from ..operators import aggregates as agg
from ..operators import folds, joins, ledger, lines, rows, windows
from ..schemas import CONTRACT_COLUMNS, ORG_COLUMNS, PAYING_COLUMNS
from ..session import scratch_dir
from ..sources import documents as docs
from ..sources import pages, sinks
from ..streaming import rates
from ..streaming.ingest import LAST_WINS, compact_pages, rate_by_window, read_pages, read_state, stream_upsert
from . import cleaning, extraction, index, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


F1 = """f1 as (
  select event_id as seq, event_id // 10 + 1 as page_num, cast(event_id % 10 as integer) as pos, user_id as b_id, 'B-' || user_id as b_bid_number,
         event_type as b_category_name, cast(floor(value) as integer) as b_status, ts as final_end_date_sort, 'D' || (user_id % 7) as department_name,
         cast(json_extract_string(props, '$.k') as integer) as b_total_quantity
  from events)"""
F2I = """f2i as (
  select 'C-' || l_orderkey as contract_number,
         cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as integer) as item_no,
         p_name as product_name, p_brand as brand, p_type as model, cast(l_quantity as integer) as quantity, cast(l_extendedprice as decimal(18,2)) as price, l_suppkey
  from lineitem join part on l_partkey = p_partkey)"""
F2C = (
    F2I
    + """, f2c as (
  select 'C-' || o_orderkey as contract_number, o_orderkey as seq, o_orderdate as contract_date, cast(o_totalprice as decimal(18,2)) as total_value,
         n_name as org_name, o_orderstatus as org_type, r_name as ministry, 'c' || c_custkey || '@buyer.test' as buyer_email, o_orderpriority as buyer_designation,
         '9' || lpad(cast(c_custkey as varchar), 9, '0') as buyer_contact, 'S' || lpad(cast(s_suppkey as varchar), 6, '0') as seller_id, s_name || '/' || o_orderstatus as company_name
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  left join f2i on f2i.contract_number = 'C-' || o_orderkey and item_no = 1 left join supplier on l_suppkey = s_suppkey)"""
)
DIMS = (
    F2C
    + """, orgs as (select org_name, arg_max(org_type, seq) as org_type, arg_min(ministry, seq) as ministry from f2c where org_name <> '' group by org_name),
buyers as (select buyer_email, arg_max(buyer_designation, seq) as buyer_designation, arg_min(buyer_contact, seq) as buyer_contact from f2c where buyer_email <> '' group by buyer_email),
sellers as (select seller_id, arg_max(company_name, seq) as company_name from f2c where seller_id <> '' group by seller_id)"""
)


def _star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Contracts with the keys of their dimensions only, and the dimensions; written once, for all that is made of them."""
    path = scratch_dir(spark, "contracts")
    fx.contracts(spark, sf_dir).write.parquet(path)
    contracts = spark.read.parquet(path)
    facts = contracts.select("contract_number", "seq", "contract_date", "total_value", "org_name", "buyer_email", "seller_id")
    return {"contracts": facts, **folds.build_dims(contracts)}


# ---- joins


@query("j1_search_contracts", f"with {DIMS} select contract_number, strftime(contract_date, '%d-%m-%Y') as contract_day, total_value, org_name, b.buyer_designation, s.company_name from (select contract_number, contract_date, total_value, org_name, buyer_email, seller_id from f2c) c left join orgs o using (org_name) left join buyers b using (buyer_email) left join sellers s using (seller_id) where contains(lower(contract_number), 'urgent') or contains(lower(coalesce(org_name, '')), 'urgent') or contains(lower(coalesce(buyer_email, '')), 'urgent') or contains(lower(coalesce(b.buyer_designation, '')), 'urgent') or contains(lower(coalesce(s.company_name, '')), 'urgent') order by contract_number limit 20")
def j1(spark, sf):
    return joins.search_contracts(_star(spark, sf), "URGENT", 20)


@query("j1_indexed_search", f"with {DIMS} select contract_number, strftime(contract_date, '%d-%m-%Y') as contract_day, total_value, org_name, b.buyer_designation, s.company_name from (select contract_number, contract_date, total_value, org_name, buyer_email, seller_id from f2c) c left join orgs o using (org_name) left join buyers b using (buyer_email) left join sellers s using (seller_id) where contains(lower(contract_number), '00005/') or contains(lower(coalesce(org_name, '')), '00005/') or contains(lower(coalesce(buyer_email, '')), '00005/') or contains(lower(coalesce(b.buyer_designation, '')), '00005/') or contains(lower(coalesce(s.company_name, '')), '00005/') order by contract_number limit 20")
def j1_indexed(spark, sf):
    """As j1, over the contracts with their dimensions stored once with an index of trigrams."""
    root, tables = scratch_dir(spark, "contract-search"), _star(spark, sf)
    substring.build(joins.contract_names(tables["contracts"], tables), root, joins.SEARCHED, "contract_number")
    return joins.shown_contracts(substring.search(spark, root, "00005/", joins.SEARCHED), 20)


@query("j2_pending", f"with {F1} select distinct b_id from f1 where b_id not in (select user_id from events where event_type = 'purchase' and event_id % 50 = 0 and user_id is not null)")
def j2(spark, sf):
    log = fx.observations(spark, sf)
    return joins.pending(log, log.where("b_category_name = 'purchase' and seq % 50 = 0"), "b_id")


@query("j3_resume", f"with {F1} select distinct page_num from f1 where page_num >= 2 and page_num % 4 = 0")
def j3(spark, sf):
    plan = fx.observations(spark, sf).select("page_num").distinct().where("page_num >= 2")
    return joins.resume(plan, plan.where("page_num % 4 <> 0"))[0]


@query("j3_resume_counts", f"with {F1} select count(*) as planned, count(*) filter (page_num % 4 <> 0) as skipped, count(*) filter (page_num % 4 = 0) as remaining from (select distinct page_num from f1 where page_num >= 2)")
def j3_counts(spark, sf):
    plan = fx.observations(spark, sf).select("page_num").distinct().where("page_num >= 2")
    return joins.resume(plan, plan.where("page_num % 4 <> 0"))[1]


@query("j4_verify_keys", "select k.o_orderkey, o.o_orderkey is not null as found from (select distinct l_orderkey * 2 as o_orderkey from lineitem) k left join (select distinct o_orderkey from orders) o on k.o_orderkey = o.o_orderkey")
def j4(spark, sf):
    keys = fx.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey"))
    return joins.verify_keys(fx.table(spark, sf, "orders"), keys, "o_orderkey")


@query("j5_match_labels", "with asked as (select p_partkey, lower(regexp_replace(case when p_partkey % 2 = 0 then p_type else p_name end, '[^A-Za-z0-9]', '', 'g')) as norm_label from part) select p_partkey, norm_label, d.label as matched_label from asked left join (select regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as k, min(p_type) as label from part group by 1) d on norm_label = d.k")
def j5(spark, sf):
    part = fx.table(spark, sf, "part")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    dim = part.groupBy(plain("p_type").alias("norm_label")).agg(F.min("p_type").alias("label")).withColumn("fill_order", F.lit(0))
    noisy = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("- "), F.initcap("p_type"), F.lit("."))).otherwise(F.col("p_name"))
    return joins.match_labels(part.select("p_partkey", plain(noisy).alias("norm_label")), dim).select("p_partkey", "norm_label", "matched_label")


@query(
    "j6_fuzzy_labels",
    """with dim as (select distinct p_type as label from part), asked as (select distinct substr(p_type, 1, 3) || 'x' || substr(p_type, 4) as norm_label from part),
    pairs as (select norm_label, label, round(1 - levenshtein(norm_label, label) / cast(greatest(length(norm_label), length(label)) as double), 12) as s from asked, dim),
    best as (select norm_label, label from pairs where s >= 0.75 qualify row_number() over (partition by norm_label order by s desc, label) = 1)
    select a.norm_label, b.label as matched_label from asked a left join best b using (norm_label)""",
)
def j6(spark, sf):
    kinds = fx.table(spark, sf, "part").select("p_type").distinct()
    dim = kinds.select(F.col("p_type").alias("label"), F.col("p_type").alias("norm_label"), F.col("p_type").alias("fill_order"))
    asked = kinds.select(F.concat(F.substring("p_type", 1, 3), F.lit("x"), F.substring("p_type", 4, 1000)).alias("norm_label")).distinct()
    return joins.match_labels(asked, dim, threshold=0.75)


@query("j7_resolve_keys", f"with {DIMS} select contract_number, org_name is not null and org_name in (select org_name from orgs) as has_org, buyer_email in (select buyer_email from buyers) as has_buyer, seller_id is not null and seller_id in (select seller_id from sellers) as has_seller from f2c")
def j7(spark, sf):
    star = _star(spark, sf)
    return joins.resolve_keys(star["contracts"], star).select("contract_number", F.col("org_id").isNotNull().alias("has_org"), F.col("buyer_id").isNotNull().alias("has_buyer"), F.col("seller_key").isNotNull().alias("has_seller"))


# ---- aggregates


@query("a1_table_stats", f"with {DIMS} select 'contracts' as table_name, count(*) as n_rows from f2c union all select 'organisations', count(*) from orgs union all select 'buyers', count(*) from buyers union all select 'sellers', count(*) from sellers union all select 'products', count(*) from f2i")
def a1(spark, sf):
    return agg.table_stats({**_star(spark, sf), "products": fx.items(spark, sf)})


@query("a2_occurrences", f"with {F1} select b_id, cast(to_json(list(page_num order by page_num)) as varchar) as pages from f1 group by b_id")
def a2(spark, sf):
    return agg.occurrences(fx.observations(spark, sf), "b_id").withColumn("pages", F.to_json("pages"))


@query("a2_occurrence_chunks", f"with {F1}, r as (select b_id, page_num, row_number() over (partition by b_id order by page_num) - 1 as k, count(*) over (partition by b_id) as n from f1) select b_id, k // 7 as chunk, n, cast(to_json(list(page_num order by page_num)) as varchar) as pages from r group by b_id, k // 7, n")
def a2_chunks(spark, sf):
    return agg.occurrence_chunks(fx.observations(spark, sf), "b_id", most=7).withColumn("pages", F.to_json("pages"))


@query("a3_duplicates", f"with {F1} select b_id, cast(to_json(list(page_num order by page_num)) as varchar) as pages from f1 group by b_id having count(*) > 1")
def a3(spark, sf):
    return agg.duplicates(fx.observations(spark, sf), "b_id").withColumn("pages", F.to_json("pages"))


@query("a4_duplicate_ratio", f"with {F1} select count(*) as n_unique, count(*) filter (n > 1) as n_duplicated, round(100.0 * count(*) filter (n > 1) / nullif(count(*), 0), 1) as percent from (select b_id, count(*) as n from f1 group by b_id)")
def a4(spark, sf):
    return agg.duplicate_ratio(fx.observations(spark, sf), "b_id")


@query("a5_contract_quantity", f"with {F2I} select contract_number, cast(sum(coalesce(quantity, 0)) as bigint) as total_quantity from f2i group by contract_number")
def a5(spark, sf):
    return agg.contract_quantity(fx.items(spark, sf))


@query("a6_redundant_pages", f"with {F1} select page_num from (select page_num, row_number() over (partition by b_id order by seq) = 1 as ins from f1) group by page_num having not bool_or(ins)")
def a6(spark, sf):
    return agg.redundant_pages(fx.observations(spark, sf), "b_id", "seq")


@query("a7_run_summary", f"with {F1} select count(*) as scraped, count(*) filter (o = 'downloaded') as downloaded, count(*) filter (o = 'skipped') as skipped, count(*) filter (o = 'failed') as failed from (select case when b_category_name = 'error' then 'failed' when row_number() over (partition by b_id order by seq) = 1 then 'downloaded' else 'skipped' end as o from f1)")
def a7(spark, sf):
    flagged = windows.flag_inserts(fx.observations(spark, sf), "b_id", "seq")
    return agg.run_summary(flagged.select(F.when(F.col("b_category_name") == "error", "failed").when(F.col("is_insert"), "downloaded").otherwise("skipped").alias("outcome")))


# ---- folds


@query(
    "m1_upsert",
    f"""with {F1}, r as (select *, row_number() over (partition by b_id order by seq) as f, row_number() over (partition by b_id order by seq desc) as l from f1)
    select a.b_id, a.page_num, a.pos, a.b_bid_number, a.b_category_name, z.b_status, z.final_end_date_sort, a.department_name, a.b_total_quantity
    from r a join r z on a.b_id = z.b_id and a.f = 1 and z.l = 1""",
)
def m1(spark, sf):
    return folds.upsert(fx.observations(spark, sf), "b_id", "seq", ("b_status", "final_end_date_sort"))


@query(
    "m1_upsert_batch",
    f"""with {F1}, r as (select *, row_number() over (partition by b_id order by seq) as f, row_number() over (partition by b_id order by seq desc) as l from f1)
    select a.b_id, a.page_num, a.pos, a.b_bid_number, a.b_category_name, z.b_status, z.final_end_date_sort, a.department_name, a.b_total_quantity
    from r a join r z on a.b_id = z.b_id and a.f = 1 and z.l = 1""",
)
def m1_batch(spark, sf):
    log, last = fx.observations(spark, sf), ("b_status", "final_end_date_sort")
    middle = log.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    state = folds.upsert(log.where(F.col("seq") <= middle), "b_id", "seq", last)
    return folds.upsert_batch(state, log.where(F.col("seq") > middle), "b_id", "seq", last)


@query("m2_organisations", f"with {DIMS} select org_name, org_type, ministry from orgs")
def m2_orgs(spark, sf):
    return folds.build_dims(fx.contracts(spark, sf))["organisations"].select("org_name", "org_type", "ministry")


@query("m2_buyers", f"with {DIMS} select buyer_email, buyer_designation, buyer_contact from buyers")
def m2_buyers(spark, sf):
    return folds.build_dims(fx.contracts(spark, sf))["buyers"].select("buyer_email", "buyer_designation", "buyer_contact")


@query("m2_sellers", f"with {DIMS} select seller_id, company_name from sellers")
def m2_sellers(spark, sf):
    return folds.build_dims(fx.contracts(spark, sf))["sellers"].select("seller_id", "company_name")


@query("m3_load_contracts", f"with {F2C} select contract_number, total_value from f2c where seq % 3 <> 0")
def m3(spark, sf):
    all_ = fx.contracts(spark, sf).select("contract_number", "seq", "total_value")
    return folds.load_contracts(all_.where("seq % 3 = 0"), all_.union(all_), fx.items(spark, sf))[0].select("contract_number", "total_value")


@query("m3_load_items", f"with {F2C} select i.contract_number, item_no, product_name, quantity, price from f2i i where contract_number in (select contract_number from f2c where seq % 3 <> 0)")
def m3_items(spark, sf):
    all_ = fx.contracts(spark, sf).select("contract_number", "seq", "total_value")
    return folds.load_contracts(all_.where("seq % 3 = 0"), all_, fx.items(spark, sf))[1].select("contract_number", "item_no", "product_name", "quantity", "price")


@query("m4_merge_sources", f"with {F2C} select contract_number as doc_id, buyer_designation as \"Buyer_Designation\", seller_id as \"Seller_GeMSellerID\", case when company_name is null then null when seq % 10 = 0 then 'again ' || company_name else company_name end as \"Seller_CompanyName\", cast(total_value as varchar) as \"TotalOrderValueINR\" from f2c")
def m4(spark, sf):
    texts, cells = fx.contract_texts(spark, sf), fx.contract_cells(spark, sf)
    columns = ["Buyer_Designation", "Seller_GeMSellerID", "Seller_CompanyName"]
    table = _cell_fields(cells).groupBy("doc_id").pivot("column", columns).agg(F.first("value"))
    return folds.merge_read(extraction.read_texts(texts, columns), table, [*columns, "TotalOrderValueINR"])


def _cell_fields(cells: DataFrame) -> DataFrame:
    """The last cell's value of each field."""
    return folds.merge_cells(extraction.extract_cells(extraction.route_cells(cells), ("buyer", "seller")))


@query("m5_assign_columns", "select user_id as doc_id, count(*) >= 1 as buyer, count(*) >= 2 as paying, count(*) >= 3 as seller from events group by user_id")
def m5(spark, sf):
    pairs = fx.table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.struct("event_id").alias("order"), F.lit("address").alias("label"), F.col("event_type").alias("value"))
    has = lambda c: F.map_contains_key("fields", F.lit(c))
    return extraction.assign_columns(pairs).select("doc_id", has("Buyer_Address").alias("buyer"), has("Paying_Address").alias("paying"), has("Seller_Address").alias("seller"))


@query(
    "m6_merge_cells",
    f"""with {F2C} select contract_number as doc_id, u.column, u.value from f2c, lateral (values
      ('Buyer_Designation', buyer_designation), ('Buyer_ContactNo', buyer_contact), ('Buyer_EmailID', buyer_email), ('Buyer_Address', 'leaked street, Ward ' || (seq % 9)),
      ('Seller_GeMSellerID', seller_id), ('Seller_CompanyName', case when seq % 10 = 0 then 'again ' || company_name else company_name end),
      ('Seller_ContactNo', case when seller_id is not null then '98' || lpad(cast(seq as varchar), 8, '0') || ', 97' || lpad(cast(seq as varchar), 8, '0') || ', 98' || lpad(cast(seq as varchar), 8, '0') end)) u("column", value)
    where u.value is not null""",
)
def m6(spark, sf):
    return _cell_fields(fx.contract_cells(spark, sf)).select("doc_id", "column", "value")


@query("m7_contact_list", "select doc_id, array_to_string(list_distinct_ordered, ', ') as contacts from (select doc_id, list_filter(n, lambda x, i: list_position(n, x) = i) as list_distinct_ordered from (select doc_id, regexp_extract_all(text, '\\d{10,}') as n from documents))")
def m7(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", extraction.contact_list(F.col("text")).alias("contacts"))


# ---- windows, order, sets, generators


@query("w1_number_items", "select 'C-' || l_orderkey as contract_number, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as integer) as item_no, l_partkey, l_quantity from lineitem")
def w1(spark, sf):
    lines_ = fx.table(spark, sf, "lineitem").withColumn("contract_number", F.concat(F.lit("C-"), "l_orderkey"))
    return windows.number_items(lines_, "contract_number", *fx.ITEM_ORDER).select("contract_number", "item_no", "l_partkey", "l_quantity")


@query("w2_flag_inserts", f"with {F1} select seq, b_id, row_number() over (partition by b_id order by seq) = 1 as is_insert from f1")
def w2(spark, sf):
    return windows.flag_inserts(fx.observations(spark, sf), "b_id", "seq").select("seq", "b_id", "is_insert")


TOTAL = "'Total Order Value (in INR) ' || format('{:,.2f}', cast(total_value as double))"
PRICE = "quantity || ' pieces ' || format('{:,.2f}', cast(price as double)) || ' NA ' || format('{:,.2f}', cast(price as double))"
CATEGORY = "'श्रेणी|Category Name & Quadrant : Q' || (item_no % 4)"


@query(
    "w3_join_continuations",
    f"""with {F2C}, n as (select contract_number, max(item_no) as items from f2i group by 1)
    select contract_number as doc_id, line from f2c left join n using (contract_number), lateral (values
      ('अनुबंध|Contract No : ' || contract_number), ('Generated Date : ' || strftime(contract_date, '%-d-%b-%Y') || ' (cid:12) Buyer Details'), ('Designation : ' || buyer_designation), ('Contact No. : ' || buyer_contact),
      ('ईमेल|Email ID : ' || buyer_email || ' Seller Details' || case when items is null then ' ' || {TOTAL} else '' end), ('GeM Seller ID : ' || seller_id), ('Company Name : ' || company_name)) u(line) where line is not null
    union all select contract_number, line from f2i join f2c using (contract_number) join n using (contract_number), lateral (values
      ('Product Name : ' || product_name), ('Brand : ' || brand || ' Brand Type : Registered'), ({CATEGORY}), ('Model : ' || model || ' ' || {PRICE} || case when item_no = items then ' ' || {TOTAL} else '' end),
      (case when item_no % 2 = 1 then 'Catalogue Status : OEM verified' end), (case when item_no % 2 = 1 then 'Selling As : Reseller not verified by OEMs' end), (case when item_no % 2 = 1 then 'HSN Code : 9608' end)) u(line) where line is not null""",
)
def w3(spark, sf):
    return lines.join_continuations(fx.contract_texts(spark, sf)).select("doc_id", "line")


@query(
    "w4_segment_blocks",
    f"""with {F2C}, n as (select contract_number, max(item_no) as items from f2i group by 1)
    select contract_number as doc_id, cast(item_no as bigint) as block, line from f2i join f2c using (contract_number) join n using (contract_number), lateral (values
      ('Product Name : ' || product_name), ('Brand : ' || brand || ' Brand Type : Registered'), ({CATEGORY}), ('Model : ' || model), ({PRICE}), (case when item_no = items then {TOTAL} end),
      (case when item_no % 2 = 1 then 'Catalogue Status : OEM verified' end), (case when item_no % 2 = 1 then 'Selling As : Reseller not verified by OEMs' end), (case when item_no % 2 = 1 then 'HSN Code : 9608' end)) u(line) where line is not null""",
)
def w4(spark, sf):
    return lines.segment_blocks(fx.contract_texts(spark, sf)).select("doc_id", "block", "line")


@query(
    "w5_rate_eta",
    """with s as (select user_id as run_id, ts, event_id, cast(row_number() over (partition by user_id order by ts, event_id) as integer) as pages, epoch_us(ts) as t from events),
    w as (select *, max(t) over r - min(t) over r as span, max(pages) over r - min(pages) over r as moved, t - min(t) over (partition by run_id) as age from s
          window r as (partition by run_id order by t range between 10000000 preceding and current row)),
    v as (select *, round(case when span > 0 then moved / (span / 1e6) when age > 0 then pages / (age / 1e6) else 0.0 end, 6) as pages_per_s from w),
    e as (select *, case when pages_per_s > 0 then cast(floor(greatest(1000 - pages, 0) / pages_per_s) as bigint) else 0 end as left_s from v)
    select run_id, ts, event_id, pages, pages_per_s, round(pages_per_s * 10, 5) as records_per_s,
           (case when left_s // 3600 < 100 then lpad(cast(left_s // 3600 as varchar), 2, '0') else cast(left_s // 3600 as varchar) end) || ':' || lpad(cast(left_s // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(left_s % 60 as varchar), 2, '0') as eta from e""",
)
def w5(spark, sf):
    return windows.rate_eta(fx.samples(spark, sf), total=1000)


@query("o1_dump_ids", "select c_custkey, c_name from customer")
def o1(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_custkey")


@query("o2_page_of", "select event_id, ts from events order by ts desc, event_id limit 10 offset 20")
def o2(spark, sf):
    return rows.page_of(fx.table(spark, sf, "events").select("event_id", "ts"), 3, F.desc("ts"), "event_id")


@query("o2_number_pages", "select event_id, (row_number() over (order by ts, event_id) - 1) // 10 + 1 as page_num from events")
def o2_all(spark, sf):
    return rows.number_pages(fx.table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "page_num")


@query("o3_top_n", f"with {F2C} select contract_number, org_name from f2c where contains(lower(org_name), 'a') order by contract_number limit 20")
def o3(spark, sf):
    return rows.first_n(rows.search_any(fx.contracts(spark, sf), "A", ["org_name"]).select("contract_number", "org_name"), 20, "contract_number")


@query("o4_first_documents", "select doc_id, text from documents order by source, doc_id limit 25")
def o4(spark, sf):
    return rows.first_n(fx.table(spark, sf, "documents"), 25, "source", "doc_id").select("doc_id", "text")


@query("u1_page_overlap", f"with {F1} select b_id from f1 where page_num = 1 intersect select b_id from f1 where page_num = 2")
def u1(spark, sf):
    return rows.page_overlap(fx.observations(spark, sf), 1, 2)


@query("u1_near_overlaps", f"with {F1}, o as (select distinct page_num, b_id from f1) select x.page_num as a, y.page_num as b, count(*) as common from o x join o y on x.b_id = y.b_id and y.page_num between x.page_num + 1 and x.page_num + 5 group by 1, 2")
def u1_all(spark, sf):
    return rows.page_overlaps(fx.observations(spark, sf), within=5)


@query("u1_shared_keys", f"with {F1}, o as (select distinct page_num, b_id from f1) select x.page_num, count(distinct x.b_id) as keys, count(distinct case when y.page_num is not null then x.b_id end) as shared, count(y.page_num) as meetings from o x left join o y on x.b_id = y.b_id and x.page_num <> y.page_num group by 1")
def u1_shared(spark, sf):
    return rows.shared_keys(fx.observations(spark, sf))


@query("u2_combine", "select o_orderkey, o_totalprice, null::varchar as o_orderpriority from orders where o_orderkey % 2 = 0 union all select o_orderkey, null, o_orderpriority from orders where o_orderkey % 2 = 1")
def u2(spark, sf):
    o = fx.table(spark, sf, "orders")
    return rows.combine(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderpriority"))


@query("g1_plan_pages", "select range as page_num from range(2, cast((select ceil(count(*) / 10.0) from events) as bigint) + 1)")
def g1(spark, sf):
    return rows.plan_pages(spark, fx.table(spark, sf, "events").count())


@query(
    "g2_orders_by_window",
    """with recursive w(n, f, u) as (select 1, min(o_orderdate)::date, least(min(o_orderdate)::date + 60, max(o_orderdate)::date) from orders
      union all select n + 1, u + 1, least(cast((u + 1) + interval 3 month as date) - 1, (select max(o_orderdate)::date from orders)) from w where u < (select max(o_orderdate)::date from orders))
    select n, cast(f as varchar) as from_day, cast(u as varchar) as to_day, count(o_orderkey) as orders from w left join orders on o_orderdate::date between f and u group by 1, 2, 3""",
)
def g2(spark, sf):
    o = fx.table(spark, sf, "orders")
    low, high = o.agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    from datetime import timedelta

    spans = d.date_windows(spark, str(low), str(min(low + timedelta(60), high)), str(high))
    days = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"))
    each = spans.withColumn("day", F.explode(F.sequence("from_day", "to_day")))
    return each.join(days, "day", "left").groupBy("n", "from_day", "to_day").agg(F.sum(F.coalesce("n_orders", F.lit(0))).alias("orders")).select("n", F.col("from_day").cast("string").alias("from_day"), F.col("to_day").cast("string").alias("to_day"), "orders")


# ---- rows


@query("p1_conform", "select o_orderkey, null::varchar as missing, o_orderstatus from orders")
def p1(spark, sf):
    return rows.conform(fx.table(spark, sf, "orders"), ["o_orderkey", "missing", "o_orderstatus"])


@query("p2_column_groups", f'with {F2C} select contract_number, org_name, org_type, null::varchar as "Paying_Role" from f2c')
def p2(spark, sf):
    return rows.conform(fx.contracts(spark, sf), ["contract_number"], include=(["org_name", "org_type"], PAYING_COLUMNS[:1]))


@query("p3_stringify", "select cast(o_orderkey as varchar) as o_orderkey, coalesce(case when o_orderkey % 5 = 0 then null else o_orderpriority end, '') as o_orderpriority from orders")
def p3(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return rows.stringify(o, ["o_orderkey", "o_orderpriority"])


@query("p4_filter_records", f"with {F2C} select contract_number, contract_date, ministry from f2c where contract_date >= timestamp '1996-01-01' and contract_date < timestamp '1997-01-01' and org_type = 'F' and contains(lower(org_name), 'tion_1')")
def p4(spark, sf):
    return rows.filter_records(fx.contracts(spark, sf), "contract_date", "1996-01-01", "1996-12-31", contains={"org_name": "TION_1", "ministry": ""}, org_type="F").select("contract_number", "contract_date", "ministry")


@query("p5_search_any", f"with {F2C} select contract_number from f2c where contains(lower(org_name), 'nation_1') or contains(lower(coalesce(company_name, '')), 'nation_1')")
def p5(spark, sf):
    return rows.search_any(fx.contracts(spark, sf), "NATION_1", ["org_name", "company_name"]).select("contract_number")


@query("p5_indexed_search", f"with {F2C} select contract_number from f2c where contains(lower(org_name), 'nation_1') or contains(lower(coalesce(company_name, '')), 'nation_1')")
def p5_indexed(spark, sf):
    """As p5, through a stored index of trigrams."""
    root, columns = scratch_dir(spark, "trigrams"), ["org_name", "company_name"]
    substring.build(fx.contracts(spark, sf).select("contract_number", *columns), root, columns, "contract_number")
    return substring.search(spark, root, "NATION_1", columns).select("contract_number")


@query("p6_first_or", "select event_id, case when event_id % 5 = 0 then -1 when event_id % 5 = 1 then null when event_id % 5 = 4 then -1 else cast(json_extract_string(props, '$.k') as integer) end as k from events")
def p6(spark, sf):
    shape = F.expr("""case event_id % 5 when 0 then '{"k":[]}' when 1 then '{"k":[null,3]}' when 2 then concat('{"k":[', get_json_object(props, '$.k'), ',9]}') when 3 then props else '{"z":1}' end""")
    return fx.table(spark, sf, "events").select("event_id", first_or(F.parse_json(shape), "k", "int", -1).alias("k"))


@query("p7_flatten_bids", f"with {F1} select page_num, pos, b_id, b_bid_number, b_category_name, b_status, final_end_date_sort, department_name, b_total_quantity from f1 where page_num % 50 <> 0")
def p7(spark, sf):
    flat = pages.flatten_bids(pages.explode_pages(fx.pages_json(spark, sf)))
    return flat.select("page_num", "pos", "b_id", "b_bid_number", "b_category_name", "b_status", "final_end_date_sort", "department_name", "b_total_quantity")


@query("p8_search_text", f"with {F1} select seq, b_category_name || ' ' || upper(b_category_name) || ' ' || b_id || ' ' || case when seq % 3 = 0 then 'M' || pos else '' end || ' ' || department_name || ' ' || b_bid_number as search_text from f1")
def p8(spark, sf):
    log = fx.observations(spark, sf).withColumns({"ministry": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("M"), "pos")), "detail": F.upper("b_category_name")})
    return log.select("seq", rows.search_text(["b_category_name", "detail", "b_id", "ministry", "department_name", "b_bid_number"]).alias("search_text"))


@query("p9_rejects", "select event_id, case when not value >= 5 then 'small' else 'error' end as reason from events where not coalesce(value >= 5, false) or event_type = 'error'")
def p9(spark, sf):
    bad = rows.split_valid(fx.table(spark, sf, "events"), {"small": F.col("value") >= 5, "error": F.col("event_type") != "error"})[1]
    return bad.select("event_id", "reason")


# ---- sources and sinks


@query("s1_join_pages", "select conv_id as doc_id, string_agg(text, chr(10) order by turn, text) as text from conversations group by conv_id")
def s1(spark, sf):
    return docs.join_pages(fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))


@query("s2_empty_documents", "select doc_id from (select doc_id, case when doc_id % 7 = 0 then '  ' else text end as text from documents) where text is null or trim(text) = ''")
def s2(spark, sf):
    return docs.empty_documents(fx.table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")))).select("doc_id")


@query("s3_explode_pages", f"with {F1} select page_num, pos, cast(b_id as varchar) as id from f1 where page_num % 50 <> 0")
def s3(spark, sf):
    return pages.explode_pages(fx.pages_json(spark, sf)).select("page_num", "pos", F.try_variant_get("doc", "$.id", "string").alias("id"))


@query("s3_bad_pages", f"with {F1} select distinct page_num from f1 where page_num % 50 = 0")
def s3_bad(spark, sf):
    return pages.bad_pages(fx.pages_json(spark, sf))


@query("s4_completeness", f"with {F1} select (select count(distinct b_id) from f1) as expected, count(distinct b_id) as landed, (select count(distinct b_id) from f1) - count(distinct b_id) as missing from f1 where page_num % 40 = 1")
def s4(spark, sf):
    """Most pages haven't landed."""
    landed = fx.pages_json(spark, sf).where("page_num % 40 = 1")
    return pages.completeness(landed, pages.flatten_bids(pages.explode_pages(landed)))


@query("s6_listing_ids", "select page_id, cast(i as integer) as pos, u as id from (select page_id, unnest(l) as u, unnest(range(len(l))) as i from (select page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) as l from pages))")
def s6(spark, sf):
    return docs.all_matches(fx.table(spark, sf, "pages"), 'href="([^"]+)"')


@query("s6_click_ids", "select page_id, cast(i as integer) as pos, u as id from (select page_id, unnest(l) as u, unnest(range(len(l))) as i from (select page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) as l from pages))")
def s6_click(spark, sf):
    """Links rewritten as a listing's header links, whose click attribute has the id."""
    clicks = F.regexp_replace("html", 'href="([^"]+)"', "href=\"#\" onclick=\"view('$1', 'x')\"")
    return docs.extract_listing_ids(fx.table(spark, sf, "pages").withColumn("html", clicks))


@query("s7_extract_links", "select page_id, case when page_id % 3 <> 0 and regexp_matches(html, 'href=\"([^\"]+)\"') then regexp_extract(html, 'href=\"([^\"]+)\"', 1) end as url, case when page_id % 3 = 0 then 'bad_status' when regexp_matches(html, 'href=\"([^\"]+)\"') then 'ok' else 'no_url' end as outcome from pages")
def s7(spark, sf):
    p = fx.table(spark, sf, "pages").withColumns({"status": F.when(F.col("page_id") % 3 == 0, "0").otherwise("1"), "html": F.replace("html", F.lit("/"), F.lit("\\/"))})
    return docs.extract_links(p).select("page_id", "url", "outcome")


@query("s9_star_contracts", f"with {F2C} select contract_number, cast(year(contract_date) as integer) as year, total_value from f2c")
def s9(spark, sf):
    path = scratch_dir(spark, "star")
    sinks.write_star(_star(spark, sf), path)
    return spark.read.parquet(f"{path}/contracts").select("contract_number", "year", "total_value")


@query("s12_report_chunks", f"""with {F1}, r as (select *, row_number() over (partition by b_id order by page_num, pos) - 1 as k, count(*) over (partition by b_id) as n from f1) select b_id, k // 9 as chunk, n, '[' || string_agg('{{"page_num":' || page_num || ',"pos":' || pos || '}}', ',' order by page_num, pos) || ']' as places from r where n > 1 group by b_id, k // 9, n""")
def s12_chunks(spark, sf):
    return agg.report_chunks(fx.observations(spark, sf), "b_id", most=9)


@query("s12_duplicate_report", f"""with {F1} select b_id, count(*) as n, '[' || string_agg('{{"page_num":' || page_num || ',"pos":' || pos || '}}', ',' order by page_num, pos) || ']' as places from f1 group by b_id having count(*) > 1""")
def s12(spark, sf):
    return agg.duplicate_report(fx.observations(spark, sf), "b_id")


@query("s13_audit_text", "select doc_id, text, trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as cleaned from documents")
def s13(spark, sf):
    return cleaning.audit_text(fx.table(spark, sf, "documents"))


@query("s5_read_keys", f"with {F1} select distinct page_num as key from f1 where page_num % 4 <> 0")
def s5(spark, sf):
    """A ledger of pages written line by line, with blanks and notes between, and read back."""
    path = scratch_dir(spark, "ledger")
    ledger = fx.observations(spark, sf).where("page_num % 4 <> 0").select(F.concat(F.lit(" "), F.col("page_num").cast("string"), F.lit(" ")).alias("value"))
    ledger.union(ledger.select(F.concat(F.lit("page "), "value"))).union(ledger.select(F.lit(""))).write.text(path)
    return docs.read_keys(spark, path, numeric=True)


@query("s8_export_tables", f"with {F2C} select contract_number as \"ContractNo\", buyer_designation as \"Buyer_Designation\", '' as \"Buyer_GSTIN\", cast(total_value as varchar) as \"TotalOrderValueINR\" from f2c")
def s8(spark, sf):
    path = scratch_dir(spark, "export")
    contracts = fx.contracts(spark, sf).select(F.col("contract_number").alias("ContractNo"), F.col("buyer_designation").alias("Buyer_Designation"), F.col("total_value").alias("TotalOrderValueINR"))
    items = fx.items(spark, sf).select(F.col("contract_number").alias("ContractNo"), F.col("item_no").alias("ItemNo"))
    sinks.export_tables(contracts, items, path, "parquet")
    return spark.read.parquet(f"{path}/contracts").select("ContractNo", "Buyer_Designation", "Buyer_GSTIN", "TotalOrderValueINR")


@query("s10_open_table", "select o_orderkey, o_orderstatus from orders")
def s10(spark, sf):
    path = scratch_dir(spark, "table")
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    orders.write.parquet(path)
    return sinks.open_table(spark, path, orders.schema, obsolete=("old_column",))


@query("s10_widened_table", "select o_orderkey, o_custkey, cast(cast(o_orderdate as date) as timestamp) as o_orderdate, cast(o_orderkey % 1000 as decimal(12,2)) as o_part, cast(null as varchar) as o_comment from orders")
def s10_widened(spark, sf):
    """A stored table with narrower types, an extra column and a missing one."""
    path = scratch_dir(spark, "table")
    fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), F.col("o_orderdate").cast("date").alias("o_orderdate"), (F.col("o_orderkey") % 1000).cast("smallint").alias("o_part"), "o_orderstatus").write.parquet(path)
    return sinks.open_table(spark, path, StructType.fromDDL("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_part decimal(12,2), o_comment string"))


@query("s11_as_of", "select u.k as taken, c_custkey, c_name from customer, (values (1), (2)) u(k) where c_custkey % 2 = 0 or u.k = 2")
def s11_as_of(spark, sf):
    """Two snapshots, read as of the first one's time and as of now."""
    root, customers = scratch_dir(spark, "snapshots"), fx.table(spark, sf, "customer").select("c_custkey", "c_name")
    first = datetime(2024, 1, 2, 3, 4, 5)
    sinks.snapshot(customers.where("c_custkey % 2 = 0"), root, first)
    sinks.snapshot(customers, root, datetime(2024, 1, 3))
    each = [sinks.read_snapshot(spark, root, at).select(F.lit(k).alias("taken"), "c_custkey", "c_name") for k, at in ((1, first), (2, None))]
    return rows.combine(*each)


@query("s11_snapshot", "select c_custkey, c_name from customer")
def s11(spark, sf):
    made = sinks.snapshot(fx.table(spark, sf, "customer").select("c_custkey", "c_name"), scratch_dir(spark, "snapshots"))
    return spark.read.parquet(made)


# ---- cleaning jobs


@query("c1_clean_corpus", "select p_partkey as doc_id, p_name || chr(10) || 'Brand : ' || p_brand || ' seler x' || chr(10) || p_type as cleaned from part")
def c1(spark, sf):
    noisy = F.concat("p_name", F.lit(" \n\n  Brand  :(cid:7) "), "p_brand", F.lit(" seelleer\x02 x\n"), "p_type", F.lit("\n "))
    return cleaning.clean_corpus(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), noisy.alias("text"))).select("doc_id", "cleaned")


@query("c2_clean_fields", f"with {F2C} select contract_number, buyer_contact, cast(cast(total_value * 100 as bigint) as varchar) as total_value, buyer_email, org_name from f2c")
def c2(spark, sf):
    noisy = fx.contracts(spark, sf).select("contract_number", F.concat(F.lit("Tel "), "buyer_contact", F.lit(", ")).alias("buyer_contact"), F.format_number("total_value", 2).alias("total_value"), F.concat("buyer_email", F.lit("\nleaked")).alias("buyer_email"), F.concat(F.lit("नाम  "), "org_name", F.lit(" (cid:3)")).alias("org_name"))
    return cleaning.clean_fields(noisy, {"buyer_contact": "contact", "total_value": "total", "buyer_email": "email", "org_name": "text"})


@query("c3_type_contracts", f"with {F2C} select contract_number, date_trunc('minute', contract_date) as contract_date, total_value from f2c")
def c3(spark, sf):
    shown = fx.contracts(spark, sf).select("contract_number", F.date_format("contract_date", "dd/MM/yyyy HH:mm").alias("contract_date"), F.format_number("total_value", 2).alias("total_value"))
    texts = fx.items(spark, sf).select("contract_number", F.col("quantity").cast("string").alias("quantity"), F.format_number("price", 2).alias("price"))
    return cleaning.type_tables(shown, texts)[0]


@query(
    "c3_rejects",
    f"""with {F2C}, told as (
  select *, case when seq % 5 = 0 then 'soon' else strftime(contract_date, '%d/%m/%Y %H:%M') end as shown_date,
         case when seq % 7 = 0 then '-' when seq % 3 = 0 then '' else format('{{:,.2f}}', cast(total_value as double)) end as shown_value
  from f2c)
select 'contracts' as table_name, contract_number, case when seq % 5 = 0 then 'contract_date' else 'total_value' end as reason,
       '{{"contract_number":"' || contract_number || '","contract_date":"' || shown_date || '","total_value":"' || shown_value || '"}}' as "row"
from told where seq % 5 = 0 or seq % 7 = 0
union all
select 'items', contract_number, 'quantity', '{{"contract_number":"' || contract_number || '","quantity":"many","price":"' || format('{{:,.2f}}', cast(price as double)) || '"}}' from f2i where item_no = 2""",
)
def c3_rejects(spark, sf):
    seq = F.col("seq")
    shown = fx.contracts(spark, sf).select("contract_number", F.when(seq % 5 == 0, "soon").otherwise(F.date_format("contract_date", "dd/MM/yyyy HH:mm")).alias("contract_date"), F.when(seq % 7 == 0, "-").when(seq % 3 == 0, "").otherwise(F.format_number("total_value", 2)).alias("total_value"))
    texts = fx.items(spark, sf).select("contract_number", F.when(F.col("item_no") == 2, "many").otherwise(F.col("quantity").cast("string")).alias("quantity"), F.format_number("price", 2).alias("price"))
    return cleaning.type_tables(shown, texts)[2]


@query("c3_type_items", f"with {F2I} select contract_number, item_no, quantity, price from f2i")
def c3_items(spark, sf):
    shown = fx.contracts(spark, sf).select("contract_number", F.lit("x").alias("contract_date"), F.lit("y").alias("total_value"))
    texts = fx.items(spark, sf).select("contract_number", "item_no", F.col("quantity").cast("string").alias("quantity"), F.format_number("price", 2).alias("price"))
    return cleaning.type_tables(shown, texts)[1]


STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
TOKENS = f"(select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) as token from documents)"


@query("c4_build_index", f"select token, doc_id from {TOKENS} where token <> '' and token not in ({STOP})")
def c4(spark, sf):
    return cleaning.build_index(fx.table(spark, sf, "documents"))


@query("c4_search_index", f"select doc_id from {TOKENS} where token in ('licensed', 'license') group by doc_id having count(*) = 2")
def c4_search(spark, sf):
    return cleaning.search_index(cleaning.build_index(fx.table(spark, sf, "documents")), ["licensed", "license"])


def _revised(spark: SparkSession, sf: str) -> str:
    """An index of all documents but each third; these are appended; then each fifth comes again with another text; then the runs are merged."""
    root, docs = scratch_dir(spark, "index"), fx.table(spark, sf, "documents").select("doc_id", "text", "source")
    index.append(docs.where("doc_id % 3 <> 0"), root)
    index.append(docs.where("doc_id % 3 = 0"), root)
    again = F.concat(F.lit("Revised, as licensed under the license of "), F.coalesce("source", F.lit("")))
    index.append(docs.where("doc_id % 5 = 0").withColumn("text", again), root)
    index.merge(spark, root)
    return root


REVISED = "(select doc_id, case when doc_id % 5 = 0 then 'Revised, as licensed under the license of ' || coalesce(source, '') else text end as text from documents)"


@query(
    "c4_search_versions",
    f"""with v as (select 1 as version, doc_id, text from documents where doc_id % 3 <> 0 union all select 2, doc_id, text from documents union all select u.k, doc_id, text from {REVISED}, (values (3), (4)) u(k)),
    w as (select distinct version, doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) as token from v)
    select version, doc_id from w where token in ('licensed', 'license') group by version, doc_id having count(*) = 2""",
)
def c4_versions(spark, sf):
    """A stored index through two appends, one of which replaces documents, and a merge; searched as of each version."""
    root = _revised(spark, sf)
    found = [index.search(spark, root, ["Licensed", "the", "license"], v).select(F.lit(v).alias("version"), F.col("key").alias("doc_id")) for v in (1, 2, 3, 4)]
    return rows.combine(*found)


@query("c4_token_counts", f"select token, count(*) as n from (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) as token from {REVISED}) where token <> '' and token not in ({STOP}) group by token")
def c4_counts(spark, sf):
    return index.token_counts(spark, _revised(spark, sf), 3)


def _expression(name: str, source: str, key: str, value, sql: str):
    """A query of one expression over a table's column."""
    query(name, f"select {key}, {sql} as result from {source}")(lambda spark, sf: fx.table(spark, sf, source).select(key, value().alias("result")))


_squeezed = "trim(regexp_replace({}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
_expression("t1_ascii_squeeze", "documents", "doc_id", lambda: t.ascii_squeeze(F.col("text")), _squeezed.format("regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"))
_expression("t2_full_clean", "part", "p_partkey", lambda: t.full_clean(F.concat(F.lit("\x02"), "p_type", F.lit(" (cid:12) , ,,  "), F.lit("seeller dettails"), F.lit(" 100"))), "p_type || ' , seler dettails 100'")
_expression("t3_layout_clean", "part", "p_partkey", lambda: t.layout_clean(F.concat("p_type", F.lit("\x03(cid:4)\nseelleer  x"))), "p_type || chr(10) || 'seler  x'")
_expression("t4_normal_lines", "documents", "doc_id", lambda: t.normal_lines(F.col("text")), "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'))), lambda x: x <> ''), chr(10))")
_expression("t5_undouble_letters", "customer", "c_custkey", lambda: t.undouble_letters(F.concat(F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"), F.lit("zzyyxx"))), "case when regexp_matches(cast(c_custkey as varchar), '(00|11|22|33|44|55|66|77|88|99)') or length(cast(c_custkey as varchar)) > 0 then (select string_agg(ch, '' order by i) from (select substr(x, i, 1) as ch, i from (select translate(cast(c_custkey as varchar), '0123456789', 'abcdefghij') || 'zzyyxx' as x), range(1, 20) r(i)) where i <= length(x) and (i = 1 or ch <> substr(x, i - 1, 1))) end".replace("from (select substr(x, i, 1) as ch, i from", "from (select x, substr(x, i, 1) as ch, i from"))
_expression("t6_clean_value", "part", "p_partkey", lambda: t.clean_value(F.concat(F.lit("नाम"), "p_name", F.lit(" (cid:1)  "), "p_brand")), "p_name || ' ' || p_brand")
_expression("t7_normal_label", "part", "p_partkey", lambda: t.normal_label(F.concat(F.col("p_size") % 10, F.lit(" Ad-dress। "))), "(p_size % 10) || 'adres'")
_expression("t8_english_label", "part", "p_partkey", lambda: t.english_label(F.concat(F.lit("नाम|x| "), "p_name")), "trim(p_name)")
_expression("t9_digit_segments", "lineitem", "l_orderkey", lambda: F.array_join(t.digit_segments(F.format_number("l_extendedprice", 2)), "-"), "replace(replace(format('{:,.2f}', cast(l_extendedprice as double)), ',', '-'), '.', '-')")
_expression("t10_repair_number", "lineitem", "l_orderkey", lambda: t.repair_number(F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)), "cast(cast(round(cast(l_extendedprice as decimal(18,2)) * 100) as bigint) as varchar)")
_expression("t10_last_segment", "orders", "o_orderkey", lambda: t.repair_number(F.format_number("o_orderkey", 0), "last_segment"), "case when o_orderkey < 1000 then cast(o_orderkey as varchar) else cast(o_orderkey % 1000 as varchar) end")
_expression("t11_halve_doubled", "orders", "o_orderkey", lambda: t.halve_doubled(F.regexp_replace(F.col("o_orderkey").cast("string"), "(.)", "$1$1")), "cast(o_orderkey as varchar)")
_expression("t12_repair_phone", "customer", "c_custkey", lambda: t.repair_phone(F.concat(F.lit("Ph: +91-"), F.lpad(F.col("c_custkey").cast("string"), 10, "9"), F.lit(" , "))), "'+91-' || lpad(cast(c_custkey as varchar), 10, '9')")
_expression("t13_decimal_of", "lineitem", "l_orderkey", lambda: t.decimal_of(F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)), "cast(l_extendedprice as decimal(18,2))")
_expression("t14_tax_id", "part", "p_partkey", lambda: t.tax_id(F.col("p_brand")), "regexp_replace(p_brand, '[^A-Za-z0-9_]', '', 'g')")
_expression("t15_or_default", "orders", "o_orderkey", lambda: t.or_default(F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")), "NA"), "case when o_orderkey % 3 = 1 then o_orderpriority else 'NA' end")
_expression("t16_search_tokens", "documents", "doc_id", lambda: F.array_join(F.array_sort(t.search_tokens(F.col("text"))), " "), f"coalesce((select string_agg(w, ' ' order by w) from (select distinct unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) as w) where w <> '' and w not in ({STOP})), '')")
_expression("d1_parse_shift_day", "orders", "o_orderkey", lambda: d.show_day(d.shift_day(d.parse_day(F.date_format("o_orderdate", "dd-MM-yyyy")), 3, -1)), "strftime(cast(cast(o_orderdate as date) + interval 3 month as date) - 1, '%d-%m-%Y')")
_expression("d2_contract_time", "orders", "o_orderkey", lambda: d.contract_time(F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).otherwise("soon")), "case when o_orderkey % 4 <> 0 then date_trunc('minute', o_orderdate) end")
_expression("d3_show_day", "orders", "o_orderkey", lambda: d.show_day(F.col("o_orderdate")), "strftime(o_orderdate, '%d-%m-%Y')")
_expression("d4_is_day", "orders", "o_orderkey", lambda: d.is_day(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("31-02-2020")), "o_orderkey % 2 = 0")


# ---- extraction


@query(
    "x1_extract_pairs",
    f"""with {F2C} select contract_number as doc_id, u.label, u.value from f2c, lateral (values
      ('Contract No', contract_number), ('Generated Date', strftime(contract_date, '%-d-%b-%Y')), ('designation', buyer_designation), ('contact no', buyer_contact), ('email id', buyer_email), ('gem seller id', seller_id), ('company name', company_name)) u(label, value) where u.value is not null
    union all select contract_number, u.label, u.value from f2i join f2c using (contract_number), lateral (values
      ('product name', product_name), ('brand', brand), ('brand type', 'Registered'), ('category name & quadrant', 'Q' || (item_no % 4)), ('model', model), ('catalogue status', case when item_no % 2 = 1 then 'OEM verified' end), ('selling as', case when item_no % 2 = 1 then 'Reseller not verified by OEMs' end), ('hsn code', case when item_no % 2 = 1 then '9608' end)) u(label, value) where u.value is not null""",
)
def x1(spark, sf):
    return extraction.extract_pairs(lines.lines_of(fx.contract_texts(spark, sf))).select("doc_id", "label", "value")


@query("x2_contract_fields", f"with {F2C} select contract_number as doc_id, buyer_designation as \"Buyer_Designation\", buyer_contact as \"Buyer_ContactNo\", buyer_email || ' Seller Details' || case when seller_id is null then ' Total Order Value (in INR) ' || format('{{:,.2f}}', cast(total_value as double)) else '' end as \"Buyer_EmailID\", seller_id as \"Seller_GeMSellerID\" from f2c")
def x2(spark, sf):
    return extraction.extract_contract_fields(fx.contract_texts(spark, sf), ["Buyer_Designation", "Buyer_ContactNo", "Buyer_EmailID", "Seller_GeMSellerID"], threshold=None)


@query("x2_fuzzy_fields", f"with {F2C} select contract_number as doc_id, cast(seq as varchar) as \"Buyer_ContactNo\", buyer_contact as \"Seller_ContactNo\" from f2c")
def x2_fuzzy(spark, sf):
    """The label of the contract's number is near to a contact's, and takes the first contact column."""
    return extraction.extract_contract_fields(fx.contract_texts(spark, sf), ["Buyer_ContactNo", "Seller_ContactNo"], threshold=0.75)


FIELDS = [*CONTRACT_COLUMNS[2:-1], *ORG_COLUMNS, *PAYING_COLUMNS]
FIELD_SQL = {
    "Buyer_Designation": "buyer_designation",
    "Buyer_ContactNo": "buyer_contact",
    "Buyer_EmailID": "buyer_email || ' Seller Details' || case when seller_id is null then ' Total Order Value (in INR) ' || format('{:,.2f}', cast(total_value as double)) else '' end",
    "Seller_GeMSellerID": "seller_id",
    "Seller_CompanyName": "company_name",
}
ALL_FIELDS_SQL = f"with {F2C} select contract_number as doc_id, " + ", ".join(f'{FIELD_SQL.get(c, "cast(null as varchar)")} as "{c}"' for c in FIELDS) + " from f2c"


@query("x2_all_fields", ALL_FIELDS_SQL)
def x2_all(spark, sf):
    return extraction.extract_contract_fields(fx.contract_texts(spark, sf), FIELDS, threshold=None)


@query("x2_assigned_fields", ALL_FIELDS_SQL)
def x2_assigned(spark, sf):
    """Misspelt labels count as the fields that they are nearest to; the contract's number, near to a contact's, is no field."""
    text = F.col("text")
    for right, wrong in (("Designation :", "Desigantion :"), ("Contact No. :", "Contact Nr. :"), ("Company Name :", "Compnay Name :"), ("GeM Seller ID :", "GeM Seler ID :")):
        text = F.replace(text, F.lit(right), F.lit(wrong))
    return extraction.extract_contract_fields(fx.contract_texts(spark, sf).withColumn("text", text), FIELDS, threshold=0.75, others=extraction.OTHERS)


@query(
    "x3_extract_block",
    f"""with {F2C} select contract_number as doc_id, u.column, u.value from f2c, lateral (values ('Buyer_Designation', buyer_designation), ('Buyer_ContactNo', buyer_contact), ('Buyer_EmailID', buyer_email), ('Buyer_Address', 'leaked street, Ward ' || (seq % 9))) u("column", value)""",
)
def x3(spark, sf):
    cells = extraction.route_cells(fx.contract_cells(spark, sf)).where("grp = 'buyer'")
    return extraction.extract_block(cells.select("doc_id", F.col("row_no").alias("block_id"), F.col("cell_text").alias("text")), "buyer").select("doc_id", "column", "value")


@query(
    "x3_block_on_one_line",
    f"""with {F2C} select contract_number as doc_id, u.column, u.value from f2c, lateral (values ('Buyer_Designation', buyer_designation || ' Note http: //x : y'), ('Buyer_ContactNo', buyer_contact), ('Buyer_EmailID', buyer_email), ('Buyer_GSTIN', 'AB12' || seq)) u("column", value)""",
)
def x3_line(spark, sf):
    """Fields that follow each other on a line, with a bilingual and a misspelt label among them, and a colon that ends no label."""
    c = fx.contracts(spark, sf)
    text = F.concat(F.lit("Buyer Details Designation : "), "buyer_designation", F.lit(" Note http: //x : y संपर्क नंबर|Contact No. : "), "buyer_contact", F.lit(" Emall ID : "), "buyer_email", F.lit(" GSTIN : AB-12 "), "seq")
    return extraction.extract_block(c.select(F.col("contract_number").alias("doc_id"), F.lit(0).alias("block_id"), text.alias("text")), "buyer").select("doc_id", "column", "value")


@query("x4_route_cells", f"with {F2C} select contract_number as doc_id, 1 as row_no, 1 as col_no, 'buyer' as grp from f2c union all select contract_number, 2, 1, 'seller' from f2c where seller_id is not null union all select contract_number, 3, 1, 'seller' from f2c where seller_id is not null and seq % 10 = 0 union all select contract_number, 4, 1, null from f2c union all select contract_number, 4, 2, null from f2c")
def x4(spark, sf):
    return extraction.route_cells(fx.contract_cells(spark, sf)).select("doc_id", "row_no", "col_no", "grp")


@query("x5_seller_contacts", f"with {F2C} select contract_number as doc_id, '98' || lpad(cast(seq as varchar), 8, '0') || ', 97' || lpad(cast(seq as varchar), 8, '0') as contacts from f2c where seller_id is not null")
def x5(spark, sf):
    return extraction.seller_contacts(fx.contract_cells(spark, sf))


@query("x6_total_from_rows", f"with {F2C} select contract_number as doc_id, cast(cast(round(total_value * 100) as bigint) as varchar) as total from f2c")
def x6(spark, sf):
    return extraction.total_from_rows(fx.contract_cells(spark, sf))


@query("x7_total_from_text", f"with {F2C} select contract_number as doc_id, total_value as total from f2c")
def x7(spark, sf):
    return extraction.total_from_text(fx.contract_texts(spark, sf)).select("doc_id", t.decimal_of(F.col("total")).alias("total"))


@query("x8_contract_header", f"with {F2C} select contract_number as doc_id, contract_number, strftime(contract_date, '%Y-%m-%d') as contract_date from f2c")
def x8(spark, sf):
    return extraction.contract_header(fx.contract_texts(spark, sf)).withColumn("contract_date", F.col("contract_date").cast("string"))


@query("x9_section", "select page_id, case when not contains(html, '<body') then '' when not contains(substr(html, strpos(html, '<body') + 5), '</p>') then substr(html, strpos(html, '<body') + 5) else trim(substr(html, strpos(html, '<body') + 5, strpos(substr(html, strpos(html, '<body') + 5), '</p>') - 1)) end as part from pages")
def x9(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", docs.section(F.col("html"), "<body", "</p>").alias("part"))


@query(
    "x10_sections",
    f"""with {F2C} select contract_number as doc_id, org_type, ministry, case when seq % 2 = 0 then 'D' || (seq % 7) end as department, org_name, 'Zone ' || (seq % 3) as office_zone,
      buyer_designation, buyer_contact, buyer_email, 'Ward ' || (seq % 9) as buyer_address, seller_id, company_name, 's' || seq || '@shop.test' as seller_email, '98' || lpad(cast(seq as varchar), 8, '0') as seller_contact,
      case when seq % 4 = 0 then 'N/A' else 'Keeper ' || (seq % 5) end as consignee_name, case when seq % 4 = 0 then 'N/A' else 'k' || seq || '@depot.test' end as consignee_email, case when seq % 4 = 0 then 'N/A' else 'Depot ' || (seq % 11) end as consignee_address,
      case when seq % 4 = 0 then '' else 's 1 Designation : Keeper ' || (seq % 5) || ' Email ID : k' || seq || '@depot.test Address : Depot ' || (seq % 11) end as consignee_text from f2c""",
)
def x10(spark, sf):
    seq = F.col("seq").cast("string")
    mod = lambda n: (F.col("seq") % n).cast("string")
    department = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Department : D"), mod(7), F.lit("\n"))).otherwise("")
    consignee = F.when(F.col("seq") % 4 != 0, F.concat(F.lit("Consignee Details\n1 Designation : Keeper "), mod(5), F.lit(" Email ID : k"), seq, F.lit("@depot.test\nAddress : Depot "), mod(11), F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit("Type : "), "org_type", F.lit(" Ministry : "), "ministry", F.lit("\n"), department, F.lit("Organisation Name : "), "org_name", F.lit("\nOffice Zone : Zone "), mod(3),
        F.lit("\nBuyer Details\nDesignation : "), "buyer_designation", F.lit(" Contact No. : "), "buyer_contact", F.lit("\nEmail ID : "), "buyer_email", F.lit(" GSTIN : - Address : Ward "), mod(9),
        F.lit("\nPaying Authority Details\nDesignation : Payer\nSeller Details\nGeM Seller ID : "), F.coalesce("seller_id", F.lit("")), F.lit("\nCompany Name : "), F.coalesce("company_name", F.lit("")), F.lit("\nContact No. : 98"), F.lpad(seq, 8, "0"), F.lit(" Email ID : s"), seq, F.lit("@shop.test\nAddress : Street\nProduct Details\n"), consignee, F.lit("Terms and Conditions\nType : none"),
    )
    return extraction.extract_sections(fx.contracts(spark, sf).select(F.col("contract_number").alias("doc_id"), text.alias("text")))


@query("x11_extract_items", f"with {F2I} select contract_number as doc_id, item_no, product_name, brand, 'Registered' as brand_type, case when item_no % 2 = 1 then 'OEM verified' end as catalogue_status, case when item_no % 2 = 1 then 'Reseller not verified by OEMs' end as selling_as, 'Q' || (item_no % 4) as category, case when item_no % 2 = 1 then '9608' end as hsn_code, model, quantity, 'pieces' as unit, price as unit_price, 'NA' as tax, price from f2i")
def x11(spark, sf):
    return extraction.extract_items(fx.contract_texts(spark, sf))


@query("x12_seller_after_marker", "select c_custkey as doc_id, '+91-98' || lpad(cast(c_custkey as varchar), 8, '0') as \"Seller_ContactNo\", 's' || c_custkey || '@shop.test' as \"Seller_EmailID\" from customer")
def x12(spark, sf):
    text = F.concat(F.lit("Selling As : Reseller not verified\nContact : 1111111 buyer@x.test\nSELLER Details\nContact No. : +91-98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("\nEmail ID : s"), "c_custkey", F.lit("@shop.test"))
    return extraction.seller_after_marker(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


# ---- attempts and rates


@query("r3_classify_attempts", "select event_id // 10 + 1 as page_num, max(event_id % 4) as attempts, case when bool_or(event_type <> 'error') then 'done' when max(event_id % 4) < 3 then 'retry' else 'dead' end as state from events group by 1")
def r3(spark, sf):
    e = fx.table(spark, sf, "events")
    return folds.classify_attempts(e.select((F.floor(F.col("event_id") / 10) + 1).alias("page_num"), (F.col("event_id") % 4).alias("attempt"), (F.col("event_type") != "error").alias("ok")))


TRIED = "(select event_id // 2 + 1 as page_num, cast(event_id % 2 * 3 as integer) as attempt, event_type in ('click', 'view') as ok from events)"


@query(
    "r3_rescrape",
    f"""with p as (select page_num, bool_or(ok) as ok, max(attempt) as attempts from {TRIED} group by 1)
    select page_num, case when ok then 'done' when attempts < 3 then 'retry' when page_num % 3 = 0 then 'done' else 'dead' end as state, case when ok or attempts < 3 then 0 when page_num % 3 = 0 then 2 else 3 end as claims from p""",
)
def r3_rescrape(spark, sf):
    """A run leaves dead pages; a rescrape claims them and dies; the next one takes them all and mends a third; the one after mends none."""
    root, e = scratch_dir(spark, "ledger"), fx.table(spark, sf, "events")
    ledger.record(e.select((F.floor(F.col("event_id") / 2) + 1).alias("page_num"), (F.col("event_id") % 2 * 3).alias("attempt"), F.col("event_type").isin("click", "view").alias("ok")), root)
    for mends in (None, 3, None):
        number = ledger.claim(spark, root)
        if number is None:
            break
        if mends is None:
            ledger.release(spark, root, number)
            continue
        tries = ledger.claimed(spark, root, number).select("page_num", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
        ledger.settle(tries.withColumn("ok", (F.col("page_num") % mends == 0) & (F.col("attempt") == 1)), root, number)
    return ledger.states(spark, root)


@query(
    "r4_live_rates",
    """with t as (select event_id, ts, epoch_us(ts) as t from events), e as (select min(t) as low, max(t) as high from t),
    b as (select t, case when t < low + (high - low) // 3 and event_id % 50 > 0 then 0 when t < low + (high - low) // 3 * 2 and t >= low + (high - low) // 3 then 1 else 2 end as batch from t, e),
    m as (select batch, max(t) as latest from b group by 1),
    j as (select b.*, t < coalesce((select max(latest) from m where m.batch < b.batch), -10000000000000000) - 30000000 as late from b),
    w as (select s, count(*) as n from (select unnest(range(t // 1000000 - 9, t // 1000000 + 1)) as s from j where not late) group by 1)
    select case when (s + 10) * 1000000 <= (select high from e) - 30000000 then 'closed' else 'open' end as kind, to_timestamp(s)::timestamp as start, n from w
    union all select 'late', make_timestamp(t), count(*) from j where late group by t""",
)
def r4_live(spark, sf):
    """Three batches of events; a fiftieth of the first third's come with the last batch."""
    landed, root, marks = (scratch_dir(spark, n) for n in ("events", "rates", "marks"))
    timed = fx.table(spark, sf, "events").select("event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    low, high = timed.agg(F.min("t"), F.max("t")).first()
    third = (high - low) // 3 if low is not None else 0
    batch = F.when((F.col("t") < F.lit(low) + third) & (F.col("event_id") % 50 > 0), 0).when((F.col("t") >= F.lit(low) + third) & (F.col("t") < F.lit(low) + 2 * third), 1).otherwise(2)
    for k in range(3):
        timed.where(batch == k).select("ts").write.mode("append").parquet(landed)
        rates.stream_rates(spark.readStream.schema("ts timestamp_ntz").parquet(landed), root, marks).awaitTermination()
    named = [df.select(F.lit(kind).alias("kind"), F.col("start").cast("timestamp_ntz").alias("start"), "n") for kind, df in (("closed", rates.closed_windows(spark, root)), ("open", rates.open_windows(spark, root)))]
    late = rates.late_events(spark, root).groupBy(F.col("ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n")).select(F.lit("late").alias("kind"), "start", "n")
    return rows.combine(*named, late)


@query("r4_rate_by_window", "select to_timestamp(s)::timestamp as start, count(*) as n from (select unnest(range(cast(floor(epoch(ts)) as bigint) - 9, cast(floor(epoch(ts)) as bigint) + 1)) as s from events) group by 1")
def r4(spark, sf):
    return rate_by_window(fx.table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "r1_stream_upsert",
    f"""with {F1}, g as (select * from f1 where page_num % 50 <> 0), r as (select *, row_number() over (partition by b_id order by seq) as f, row_number() over (partition by b_id order by seq desc) as l from g)
    select a.b_id, a.b_bid_number, a.b_category_name, z.b_status, z.final_end_date_sort, a.department_name, a.b_total_quantity
    from r a join r z on a.b_id = z.b_id and a.f = 1 and z.l = 1""",
)
def r1(spark, sf):
    """Pages land as files in page order, a batch at a time, and are folded as a stream."""
    landed, state, marks = (scratch_dir(spark, n) for n in ("landed", "state", "marks"))
    landed_pages = fx.pages_json(spark, sf)
    half = (landed_pages.agg(F.max("page_num")).first()[0] or 0) // 2
    for part in (F.col("page_num") <= half, F.col("page_num") > half):
        named = landed_pages.where(part).select(F.to_json(F.struct("page_num", "body")).alias("value"))
        named.write.mode("append").text(landed)
        stream_upsert(spark, landed, state, marks).awaitTermination()
    return read_state(spark, state).select("b_id", "b_bid_number", "b_category_name", "b_status", "final_end_date_sort", "department_name", "b_total_quantity")


@query(
    "r1_versions",
    f"""with {F1}, h as (select max(page_num) // 2 as half from f1), g as (select u.k as after, f1.* from f1, h, (values (0), (1)) u(k) where page_num % 50 <> 0 and (u.k = 1 or page_num <= half)),
    r as (select *, row_number() over (partition by after, b_id order by seq) as f, row_number() over (partition by after, b_id order by seq desc) as l from g)
    select a.after, a.b_id, a.b_category_name, z.b_status, z.final_end_date_sort, (select count(distinct page_num) from f1) as pages_read from r a join r z on a.after = z.after and a.b_id = z.b_id and a.f = 1 and z.l = 1""",
)
def r1_versions(spark, sf):
    """Two batches with other numbers of buckets, the landed pages then put together; the state as it was after each batch."""
    landed, state, marks = (scratch_dir(spark, n) for n in ("landed", "state", "marks"))
    landed_pages = fx.pages_json(spark, sf)
    half = (landed_pages.agg(F.max("page_num")).first()[0] or 0) // 2
    for part, buckets in ((F.col("page_num") <= half, 7), (F.col("page_num") > half, 11)):
        landed_pages.where(part).select(F.to_json(F.struct("page_num", "body")).alias("value")).write.mode("append").text(landed)
        stream_upsert(spark, landed, state, marks, max_files=100_000, buckets=buckets).awaitTermination()
    compact_pages(spark, state)
    pages_read = read_pages(spark, state).agg(F.count("page_num").alias("pages_read"))
    each = [read_state(spark, state, batch=k).select(F.lit(k).alias("after"), "b_id", "b_category_name", "b_status", "final_end_date_sort") for k in (0, 1)]
    # one row
    return rows.combine(*each).join(F.broadcast(pages_read))


@query(
    "r2_resume",
    f"""with {F1}, g as (select * from f1 where page_num % 50 <> 0), r as (select *, row_number() over (partition by b_id order by seq) as f, row_number() over (partition by b_id order by seq desc) as l from g)
    select a.b_id, a.b_category_name, z.b_status, z.final_end_date_sort, (select count(distinct page_num) from f1) as pages_read from r a join r z on a.b_id = z.b_id and a.f = 1 and z.l = 1""",
)
def r2(spark, sf):
    """A run that stops after a third of the pages; the next one plans what is left, lands it, and goes on from the checkpoint. Each page is read once."""
    landed, state, marks = (scratch_dir(spark, n) for n in ("landed", "state", "marks"))
    plan = fx.pages_json(spark, sf)
    third = (plan.agg(F.max("page_num")).first()[0] or 0) // 3
    land = lambda pages: pages.select(F.to_json(F.struct("page_num", "body")).alias("value")).write.mode("append").text(landed)
    land(plan.where(F.col("page_num") <= third))
    stream_upsert(spark, landed, state, marks).awaitTermination()
    land(joins.resume(plan, read_pages(spark, state))[0])
    for _ in range(2):  # the second has nothing to do
        stream_upsert(spark, landed, state, marks).awaitTermination()
    pages_read = read_pages(spark, state).agg(F.count("page_num").alias("pages_read"))
    # one row
    return read_state(spark, state).select("b_id", "b_category_name", "b_status", "final_end_date_sort").join(F.broadcast(pages_read))
