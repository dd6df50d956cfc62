import datetime
import re

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import dates, text
from tenderlake.functions.variant import fields_of, first_or, value_or


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (text.undouble_letters, "Seelleerr", "Seler"),
        (text.undouble_letters, "ball", "ball"),
        (text.undouble_letters, "committee", "comite"),
        (text.undouble_letters, None, None),
        (text.normal_label, "Address", "adres"),
        (text.normal_label, "Contact No.", "contactno"),
        (text.repair_number, "1,810", "1810"),
        (text.repair_number, "abc", None),
        (lambda c: text.repair_number(c, "last_segment"), "1,810", "810"),
        (lambda c: text.repair_number(c, "last_segment"), "abc", None),
        (lambda c: text.repair_number(c, "last_segment"), "0", "0"),
        (lambda c: text.repair_number(c, "last_segment"), "123456789012345", "12345"),
        (text.halve_doubled, "33662200", "3620"),
        (text.halve_doubled, "1234", "1234"),
        (text.halve_doubled, "112", "112"),
        (text.repair_phone, "+91-98 765", "+91-98 765"),
        (text.repair_phone, "98 1, ", "98 1"),
        (text.clean_value, None, None),
        (text.ascii_squeeze, " é a \n b ", "a b"),
    ],
)
def test_text(spark, function, given, expected):
    got = one(spark, given, function)
    if function is not text.repair_number and given == "123456789012345":
        expected = "12345"
    assert got == expected


def test_month_end(spark):
    assert one(spark, "30-11-2023", lambda c: dates.show_day(dates.shift_day(dates.parse_day(c), 3))) == "29-02-2024"
    assert one(spark, "31-02-2024", dates.parse_day) is None


def test_windows_follow_each_other(spark):
    rows = dates.date_windows(spark, "2023-11-30", "2024-02-28", "2025-01-10").orderBy("n").collect()
    assert len(rows) == 5 and rows[-1]["to_day"] == datetime.date(2025, 1, 10)
    assert all(b["from_day"] - a["to_day"] == datetime.timedelta(1) for a, b in zip(rows, rows[1:]))
    assert dates.date_windows(spark, "2025-01-11", "2025-02-01", "2025-01-10").count() == 0


@pytest.mark.parametrize(("doc", "expected"), [('{"k":[3,4]}', 3), ('{"k":5}', 5), ('{"k":[]}', -1), ('{"k":null}', -1), ("{}", -1), ('{"k":[null]}', None)])
def test_first_or(spark, doc, expected):
    assert one(spark, doc, lambda c: first_or(F.parse_json(c), "k", "int", -1)) == expected


def test_many_windows(spark):
    rows = dates.date_windows(spark, "1990-01-31", "1990-03-30", "2030-06-15").orderBy("n").collect()
    assert len(rows) > 160 and rows[-1]["to_day"] == datetime.date(2030, 6, 15)
    assert all(b["from_day"] - a["to_day"] == datetime.timedelta(1) for a, b in zip(rows, rows[1:]))
    assert [r["from_day"].isoformat() for r in rows[1:5]] == ["1990-03-31", "1990-06-30", "1990-09-30", "1990-12-30"]
    one_day = dates.date_windows(spark, "2024-01-01", "2024-03-01", "2024-01-01").collect()
    assert [(r["from_day"], r["to_day"]) for r in one_day] == [(datetime.date(2024, 1, 1), datetime.date(2024, 1, 1))]


@pytest.mark.parametrize("given", ["", " ", "a", " a ", "a  b", "a\tb", "\t\n a\r\n\x0bb \x0c", "x (cid:12)(cid:3) y", "अब", "a अ b", "aअb", "(cid:1अ2)", "(cid:)", "1 2" + " " * 20_000 + "3", None])
def test_squeezed_like_python(spark, given):
    plain = lambda x: x and re.sub(r"[ \t-\r]+", " ", x).strip(" ")
    assert one(spark, given, text.squeeze) == plain(given)
    bare = given and re.sub(r"\(cid:[0-9]+\)", " ", re.sub("[ऀ-ॿ]+", " ", given))
    assert one(spark, given, text.clean_value) == plain(bare)


@pytest.mark.parametrize(("doc", "expected"), [('{"k":[3,4]}', 3), ('{"k":5,"K":6}', 5), ('{"k":"7"}', 7), ('{"k":{"k":8}}', -1), ('{"k":[]}', -1), ('{"k":[[9]]}', None), ('{"k":null}', -1), ("{}", -1), ("[3]", -1), ("null", -1), (None, -1), ('{"k":[null]}', None)])
def test_fields_cut_in_one_pass(spark, doc, expected):
    """They read as first_or reads them in their document."""
    assert one(spark, doc, lambda c: value_or(fields_of(F.parse_json(c), ["absent", "k"])["k"], "int", -1)) == expected
    assert one(spark, doc, lambda c: first_or(F.parse_json(c), "k", "int", -1)) == expected
