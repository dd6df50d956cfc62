"""Operators at more rows than the tables have, and at the edges of their definitions."""

import re

import pytest
from pyspark.sql import functions as F

from tenderlake import schemas
from tenderlake.operators import aggregates, folds, joins, lines, rows, windows
from tenderlake.plans import extraction


@pytest.mark.parametrize("parts", ["7", "64"])
def test_number_pages_of_many_rows(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 1_200_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.lit("x" * 20).alias("wide"))
        paged = rows.number_pages(df, "k")
        assert paged.columns == df.columns + ["page_num"]
        assert paged.count() == n
        assert paged.where(F.col("page_num") != F.floor(F.col("k") / 10) + 1).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows.number_pages(df.limit(0), "k").count() == 0


def test_labels_by_pieces_are_those_by_comparison(spark):
    words = ["contact no", "contactno", "email id", "emailid", "address", "adress", "brand type", "x", "ab", "gstin", "gst in", "categoryname", "model"]
    noisy = [w[:i] + c + w[i + 1 :] for w in words for i in range(len(w)) for c in ("", "q", "zz")]
    asked = spark.createDataFrame([(x,) for x in [*noisy, *words, None, ""]], "norm_label string")
    dim = spark.createDataFrame([(w, w.upper(), k) for k, w in enumerate(words)], "norm_label string, label string, fill_order int")
    for threshold in (0.6, 0.75, 0.9):
        whole = sorted(map(repr, joins.match_labels(asked, dim, threshold=threshold).distinct().collect()))
        assert sorted(map(repr, joins.match_labels(asked, dim, threshold=threshold, small=0).distinct().collect())) == whole


def test_labels_that_are_no_field(spark):
    """A label that is nearer to another one than to the dictionary's has no match; a misspelt one has."""
    asked = spark.createDataFrame([("contractno",), ("contractnos",), ("contactnr",), ("contactno",), ("contcatno",), (None,)], "norm_label string")
    dim = spark.createDataFrame([("contactno", "contact no", 0), ("emailid", "email id", 1)], "norm_label string, label string, fill_order int")
    found = lambda **more: {r["norm_label"]: r["matched_label"] for r in joins.match_labels(asked, dim, threshold=0.75, **more).collect()}
    assert found() == {"contractno": "contact no", "contractnos": "contact no", "contactnr": "contact no", "contactno": "contact no", "contcatno": "contact no", None: None}
    for small in (10, 0):
        assert found(others=("contractno",), small=small) == {"contractno": None, "contractnos": None, "contactnr": "contact no", "contactno": "contact no", "contcatno": None, None: None}
    assert found(others=("contractno",), margin=0.2)["contactnr"] is None


def test_a_long_head_is_no_label(spark):
    docs = spark.createDataFrame([(1, 0, f"{'x' * 90} : y Designation : Clerk"), (1, 1, f"{'x' * 80} : y")], "doc_id long, pos int, line string")
    got = {(r["pos"], r["n"]): (r["label"], r["value"]) for r in extraction.extract_pairs(docs).collect()}
    assert got == {(0, 0): (None, f"{'x' * 90} : y"), (0, 1): ("designation", "Clerk"), (1, 0): ("x" * 80, "y")}


def test_rates_of_a_long_run_in_parts(spark):
    """One run over many parts gives the rows of one over one part; ties, gaps and rows without a time among them."""
    rows_ = spark.range(4000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.lit("r")).alias("run_id"), F.timestamp_micros((F.col("id") * F.col("id") * 37 % 900_000_000)).cast("timestamp_ntz").alias("ts"), (F.col("id") + 1).alias("pages"))
    rows_ = rows_.union(spark.createDataFrame([("r", None, 5), ("s", None, 1)], rows_.schema)).union(rows_.limit(20)).repartition(5)
    whole = windows.rate_eta(rows_, total=5000, part_rows=1 << 30)
    parts = windows.rate_eta(rows_, total=5000, part_rows=40)
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect())) and whole.count() == rows_.count()
    cut = windows._parts(rows_, "run_id", 10, 40)
    assert cut.where("run_id = 'r'").groupBy("_part").count().count() > 50


def test_chunks_of_a_hot_key(spark):
    """No list is longer than the bound, and places go on in order from chunk to chunk, over many ranges."""
    log = spark.range(5000).select(F.when(F.col("id") % 5 < 4, 1).when(F.col("id") % 50 == 4, None).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 1000).alias("page_num"), F.col("id").alias("pos")).repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = aggregates.occurrence_chunks(log, "k", most=64).collect()
        twice = aggregates.report_chunks(log, "k", most=64).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(len(r["pages"]) for r in found) == 64
    whole = {r["k"]: r["pages"] for r in aggregates.occurrences(log, "k").collect()}
    got = {}
    for r in sorted(found, key=lambda r: (r["k"] is None, r["k"], r["chunk"])):
        assert r["n"] == len(whole[r["k"]]) and r["chunk"] * 64 == len(got.setdefault(r["k"], []))
        got[r["k"]] += r["pages"]
    assert got == whole
    assert {r["k"] for r in twice} == {k for k, v in whole.items() if len(v) > 1}
    assert aggregates.occurrence_chunks(log.limit(0), "k").count() == 0


def test_shared_keys_of_no_pages(spark):
    empty = spark.createDataFrame([], "page_num long, b_id long")
    assert rows.shared_keys(empty).count() == 0
    one = spark.createDataFrame([(1, 5), (1, 5), (1, None)], "page_num long, b_id long")
    assert rows.shared_keys(one).first().asDict() == {"page_num": 1, "keys": 1, "shared": 0, "meetings": 0}


def test_lines_fold_in_their_row(spark):
    docs = spark.createDataFrame([("d", "top\na : 1\n\n  more\nb : 2\n"), ("d", "Product Name : x\nProduct Name :y\nz"), ("e", None), ("e", ""), ("e", "no colon")], "doc_id string, text string")
    assert [tuple(r) for r in lines.join_continuations(docs).collect()] == [("d", 0, "a : 1 more"), ("d", 1, "b : 2"), ("d", 0, "Product Name : x"), ("d", 1, "Product Name :y z")]
    assert [(r["block"], r["line"]) for r in lines.segment_blocks(docs).collect()] == [(1, "Product Name : x"), (2, "Product Name :y"), (2, "z")]


def test_fields_within_a_line(spark):
    docs = spark.createDataFrame([(1, "Designation : Clerk Contact No. : 0123456789")], "doc_id long, text string")
    found = extraction.extract_block(docs.withColumn("block_id", F.lit(0)), "buyer").collect()
    assert {(r["column"], r["value"]) for r in found} == {("Buyer_Designation", "Clerk"), ("Buyer_ContactNo", "0123456789")}
    fields = extraction.extract_contract_fields(docs.union(docs), ["Buyer_Designation", "Buyer_ContactNo"], threshold=None)
    assert [tuple(r) for r in fields.collect()] == [(1, "Clerk", "0123456789")] * 2


def test_reseller_is_no_seller(spark):
    text = "Selling As : Reseller not verified\nContact No. : 1111111111\nSeller Details\nContact No. : 2222222222\nmail to <a.b@c.test>."
    docs = spark.createDataFrame([(1, text), (2, "Reseller\nContact : 1111111"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in extraction.seller_after_marker(docs).collect()] == [(1, "2222222222", "a.b@c.test"), (2, None, None), (3, None, None)]


def test_item_fields(spark):
    text = "Product Name : pen\nBrand : Unbranded Brand Type : NA\nHSN Code : 9608\n12 pieces 1,810.50 NA 21,726\nTotal Order Value (in INR) 21,726"
    row = extraction.extract_items(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["item_no"], row["brand"], row["brand_type"], row["hsn_code"], row["quantity"], str(row["unit_price"]), row["tax"], str(row["price"])) == (1, "Unbranded", "NA", "9608", 12, "1810.50", "NA", "21726.00")


def test_labels_as_a_tree(spark):
    lines = [
        "Brand : Acme Brand Type : Registered Modeel : X:1",
        "BRAND TYPE: Registered",
        "Brraand  Typpe - : Registered",
        "brands : none",
        "Category Name and Quadrant : Q1 HSN Code:",
        "यह|Model : M (cid:7) 2",
        ":",
        "time 10:30",
    ]
    docs = spark.createDataFrame([(1, n, x) for n, x in enumerate(lines)], "doc_id int, pos int, line string")
    got = {}
    for r in extraction.extract_pairs(docs).orderBy("pos", "n").collect():
        got.setdefault(r["pos"], []).append((r["label"], r["value"]))
    assert got == {
        0: [("brand", "Acme"), ("brand type", "Registered"), ("model", "X:1")],
        1: [("brand type", "Registered")],
        2: [("brand type", "Registered")],
        3: [("brands", "none")],
        4: [("category name and quadrant", "Q1"), ("hsn code", "")],
        5: [("model", "M 2")],
        6: [("", "")],
        7: [("time 10", "30")],
    }


def test_header_number(spark):
    docs = spark.createDataFrame([("d", "Contract No : C-1, of 3-Jan-2024"), ("e", "Contract No : (x)"), ("f", "Contract No :"), ("g", None), ("h", "Contract No : C_2")], "doc_id string, text string")
    header = extraction.contract_header(docs)
    assert [(r["contract_number"], str(r["contract_date"])) for r in header.collect()] == [("C-1", "2024-01-03"), ("e", "None"), ("f", "None"), ("g", "None"), ("C", "None")]
    assert "split(" not in header._jdf.queryExecution().optimizedPlan().toString()


def test_sections_in_one_pass(spark):
    """What cut_at_labels gives, with one pattern for all labels instead of one for each pair."""
    labels = ["Designation", "Contact No.", "Email ID", "Address"]
    texts = ["Designation : a Contact No. : 1 Designation : b address: x : y", "EMAIL ID:  Address :", "no label", "", None, "xDesignation : a", "Contact No. : 1 Contact No. : 2 Email ID : e Contact No. : 3", "Address : é ÉEmail ID : z"]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    slow, fast = extraction.cut_at_labels(F.col("text"), labels), extraction.cut_once(F.col("text"), labels)
    both = docs.select(F.array(*slow.values()).alias("slow"), F.array(*[F.try_element_at(fast, F.lit(x.lower())) for x in labels]).alias("fast")).collect()
    assert [r["slow"] for r in both] == [r["fast"] for r in both]
    plan = extraction.extract_sections(docs.select(F.lit(1).alias("doc_id"), "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_instr" not in plan


def test_misspelt_labels_cut_texts_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = [(1, "Desigantion : Clerk\nContact Nr. : 0123\nModel : m"), (1, "Desigantion : Head"), (2, "Model : m"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInPandas(count, "doc_id long, text string")
    read = lambda: sorted(tuple(r) for r in extraction.extract_contract_fields(docs, ["Buyer_Designation", "Buyer_ContactNo"], threshold=0.75, others=extraction.OTHERS).collect())
    first = read()
    assert first == [(1, "Clerk", "0123"), (1, "Head", None)]
    assert seen.value == len(rows)
    monkeypatch.setattr(extraction, "MOST_SPELLINGS", 0)
    assert read() == first


def test_gathering_tasks_follow_the_rows(spark, monkeypatch):
    """The tasks that gather a document's cells are as many as the rows need, whatever the session's shuffle partitions."""
    monkeypatch.setattr(rows.by_key, "__kwdefaults__", {"rows_a_task": 10})
    cells = spark.range(1000).selectExpr("cast(id % 500 as string) as doc_id", "'c' as column", "cast(id as string) as value", "1 as page_no", "1 as table_no", "cast(id div 500 as int) as row_no", "1 as col_no")
    merged = folds.merge_cells(cells)
    assert merged.rdd.getNumPartitions() == 100
    assert {(r["doc_id"], r["value"]) for r in merged.collect()} == {(str(k), str(k + 500)) for k in range(500)}


def test_cells_are_cut_in_one_pass(spark):
    """Each cell by its group's labels; an unlabelled colon, tabs and a bar need a closer look, with the same result."""
    texts = {1: ("buyer", "Buyer Details\nDesignation : Head\nEmail ID : a@b.c\nleaked street\nAddress : Ward 1"), 2: ("seller", "Company Name :\tX  Y\nSeller Contact : 99 Note: z\nईमेल|Email ID : s@t.u"), 3: (None, "Address : none")}
    cells = spark.createDataFrame([("d", 1, 1, k, 1, g, x) for k, (g, x) in texts.items()], "doc_id string, page_no int, table_no int, row_no int, col_no int, grp string, cell_text string")
    out = extraction.extract_cells(cells, ("buyer", "seller"))
    assert {(r["row_no"], r["column"], r["value"]) for r in out.collect()} == {
        (1, "Buyer_Designation", "Head"), (1, "Buyer_EmailID", "a@b.c"), (1, "Buyer_Address", "leaked street, Ward 1"),
        (2, "Seller_CompanyName", "X Y"), (2, "Seller_ContactNo", "99"), (2, "Seller_EmailID", "s@t.u"),
    }
    assert "Union" not in out._jdf.queryExecution().toString()


def test_totals_of_rows_are_gathered_by_as_many_tasks_as_need_be(spark, monkeypatch):
    monkeypatch.setattr(rows.by_key, "__kwdefaults__", {"rows_a_task": 10})
    texts = {1: "Total Order Value", 2: "1,234.50", 3: None}
    cells = spark.range(100).selectExpr("cast(id as string) as doc_id").crossJoin(spark.createDataFrame([(k, x) for k, x in texts.items()], "col_no int, cell_text string")).selectExpr("doc_id", "1 as page_no", "1 as table_no", "1 as row_no", "col_no", "cell_text")
    totals = extraction.total_from_rows(cells)
    assert totals.rdd.getNumPartitions() == 20
    assert {(r["doc_id"], r["total"]) for r in totals.collect()} == {(str(k), "123450") for k in range(100)}


def test_lines_of_other_labels_are_dropped_uncut(spark):
    """Only where all labels of a line are others, as they are spelt; a field among them keeps the line."""
    asked = {"Brand : X Brand Type : Registered": True, "श्रेणी|Category Name & Quadrant : Q1": True, "Brand : X": True, "Type : F": False, "Brand : X Type : F": False, "Brannd : X": False, "Brand : X Note : y": False, "Address : 1 Model : m": False}
    df = spark.createDataFrame([(x,) for x in asked], "line string")
    only = [x for g, x, _ in schemas.LABELS if g != "product"]
    assert {r["line"]: r["u"] for r in df.select("line", extraction.unlike(F.col("line"), only).alias("u")).collect()} == asked


def test_what_texts_say_is_read_in_one_row(spark):
    docs = spark.createDataFrame([("d", "Designation : Head\nBrand : X Brand Type : R\nmore\nSeller\nContact No. : 98765\nx@y.in\nTotal Order Value (in INR) 1,234.50"), ("e", None)], "doc_id string, text string")
    read = extraction.read_texts(docs, ["Buyer_Designation", "Seller_ContactNo"])
    assert "Join" not in read._jdf.queryExecution().toString()
    tables = spark.createDataFrame([("d", "Clerk")], "doc_id string, Buyer_Designation string")
    columns = ["Buyer_Designation", "Seller_ContactNo", "Seller_EmailID", "TotalOrderValueINR"]
    merged = {r["doc_id"]: tuple(r)[1:] for r in folds.merge_read(read, tables, columns).collect()}
    assert merged == {"d": ("Clerk", "98765", "x@y.in", "1234.50"), "e": (None, None, None, None)}


def test_colons_far_from_all_labels_are_not_compared(spark):
    """What `_label_at_end` finds a label in fits the pattern that is tried first; plain words don't. Labels in even parts of an uneven line are cut as they stand."""
    known = extraction._known(("buyer",))
    texts = ["Emall ID", "Desigantion", "Addres", "Adddress", "ContactNo", "x GST IN", "Contact1", "http", "5-LOW at 10", "x", "", "Ward seven"]
    flat = F.regexp_replace(F.lower("t"), "[^a-z0-9]+", "")
    asked = spark.createDataFrame([(x,) for x in texts], "t string").select("t", extraction._label_at_end(F.col("t"), known, 0.75).isNotNull().alias("is"), flat.rlike(extraction._reach(known, 0.75)).alias("near"))
    got = {r["t"]: (r["is"], r["near"]) for r in asked.collect()}
    assert all(got[x] == (True, True) for x in texts[:7]) and all(got[x] == (False, False) for x in texts[7:])
    assert extraction._reach(known, 0.0) is None
    docs = spark.createDataFrame([(1, 0, "a|b Designation : Clerk  x http: y GSTIN : A-1\nEmail ID : a@b.c\nleak  ed\nAddress : Ward")], "doc_id int, block_id int, text string")
    assert {(r["column"], r["value"]) for r in extraction.extract_block(docs, "buyer").collect()} == {("Buyer_Designation", "Clerk x http: y"), ("Buyer_GSTIN", "A1"), ("Buyer_EmailID", "a@b.c"), ("Buyer_Address", "leak  ed, Ward")}


def test_continued_odd_texts(spark):
    """Lines joined one by one are those of plain Python, whatever white space stands among them."""
    texts = ["", "A:1", "\nA:10", "x\nA:1\n", "A:1\n\n b \n\t\nC: 2\r\nD", "A: 1\r\n\r\nx  y\r\nB:2\r\n", "a\x0bb:1\n\x0c\nc", "\n\n:\n\n", "A :  1 \n  : 2", "no", None]

    def plain(text):
        out = []
        for x in text.split("\n"):
            if ":" in x:
                out.append(x)
            elif out:
                out[-1] += " " + x
        return [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for x in out]

    found = spark.createDataFrame([(x,) for x in texts], "text string").select(lines.continued(F.col("text")).alias("x"))
    assert [r["x"] for r in found.collect()] == [None if x is None else plain(x) for x in texts]


def test_labels_are_read_once_a_spelling(spark):
    """What stands before a line's only colon tells the label without the rest: the same pairs as of whole lines."""
    told = ["Contract No : C-1", "अनुबंध|Contract No : C-1", "Compnay Name : x  y", "some words Email ID : a@b", "ईमेल|Email ID : a (cid:3)", "Brand : a Brand Type : b", "x" * 90 + " : long", "x" * 90 + " Email ID : long", "Contact No. :", ": none", "12:30", "GSTIN\x1e : a\x1fb", "Type: Office Zone", "Desigantion : d:e", "Category Name & Quadrant : श्रेणी Q1"]
    df = spark.createDataFrame([(x,) for x in told], "line string")
    raw = F.transform(extraction._raw_pairs(F.col("line")), lambda p: F.struct(extraction._label_of(p["label"]).alias("label"), extraction._value_of(p).alias("value")))
    whole = extraction.line_pairs(F.col("line"))
    for r in df.select("line", F.filter(raw, lambda p: p["label"].isNotNull()).alias("a"), F.filter(whole, lambda p: p["label"].isNotNull()).alias("b"), extraction._raw_pairs(F.col("line"))["label"].alias("spelt")).collect():
        assert r["a"] == r["b"], r["line"]
        assert (r["spelt"] == [r["line"].split(":")[0] + ":"]) == (r["line"].count(":") == 1 and len(r["line"].split(":")[0]) <= 80 and "\x1e" not in r["line"]), r["line"]
