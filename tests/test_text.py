import datetime
import os

import pytest
from pyspark.sql import functions as F

from paperloom.functions import keys as K
from paperloom.functions import text as T


@pytest.mark.parametrize(
    ("text", "p6", "p10", "p11"),
    [
        ("$24,950.00", 24950.0, 24950.0, 24950.0), ("($140.00)", None, -140.0, -140.0), ("-$25,500", -25500.0, -25500.0, -25500.0), ("1O5", 105.0, None, 15.0),
        ("4,8l0", 4810.0, None, 480.0), ("30 Years", 30.0, None, 30.0), ("03/18/2026", 3182026.0, None, 3182026.0), ("03-18-2026", None, None, None),
        ("$1,000 (10%)", None, None, 100010.0), ("1.2.3", None, None, None), ("", None, None, None), (None, None, None, None),
    ],
)
def test_money(value, text, p6, p10, p11):
    assert (value(T.money, text), value(T.table_money, text), value(T.check_money, text)) == (p6, p10, p11)


@pytest.mark.parametrize(("text", "x"), [("9.875%", 9.875), ("-1.5%", 1.5), ("l0.5%", 10.5), ("Total 5%", 15.0), ("%", None), ("", None)])
def test_percent(value, text, x):
    assert value(T.percent, text) == x


@pytest.mark.parametrize(
    ("text", "shown", "day"),
    [
        ("3/8/26", "03/08/2026", (2026, 3, 8)), ("03/14/2O26", "03/14/2026", None), ("2026-03-18", "2026-03-18", (2018, 26, 3)),
        ("13/45/2026", "13/45/2026", (2026, 13, 45)), ("March 18, 2026", "March 18, 2026", None),
    ],
)
def test_dates(value, text, shown, day):
    assert value(T.date_text, text) == shown
    got = value(T.date_tuple, text)
    assert (tuple(got.values()) if got else None) == day


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("2O26", "2026"), ("$ O", "$0"), ("100|200", "1001200"), ("S123", "5123"), ("S1", "S1"), ("Z1234", "21234"), ("1B2", "182"), ("Closing Disclosure", "Closing Disdosure"),
        ("CLOSING DISCLOSURE", "CLOSING DISCLOSURE"), ("government", "govemment"), ("application", "apphcation"), ("a\n\n\nb", "a  b"), (" a\n b ", "a\nb"), (" a \n b", "a  b"), (None, None), ("", ""),
    ],
)
def test_clean_text(value, text, clean):
    assert value(T.clean_text, text) == clean


def test_clean_text_without_word_rules(value):
    assert value(lambda c: T.clean_text(c, word_rules=False), "Closing Disclosure 2O26") == "Closing Disclosure 2026"


@pytest.mark.parametrize(
    ("field", "text", "bad"),
    [
        ("prepaids", "($140.00)", None), ("prepaids", "-$140.00", None), ("prepaids", "1,234", None), ("prepaids", "$-140", "money"), ("prepaids", "$ 140", "money"), ("prepaids", "140.005", "money"),
        ("interest_rate", "83.5", None), ("interest_rate", "83.5 %", None), ("interest_rate", "1000%", "percent"), ("date_issued", "03/18/2026", None), ("date_issued", "2026-03-18", "date"), ("other", "x", None), ("prepaids", None, "money"),
    ],
)
def test_format(value, field, text, bad):
    assert value(T.format_fails, field, text) == bad


def test_page_rules(value):
    assert value(T.render_dpi, "x" * 79) == 200 and value(T.render_dpi, "x" * 80) == 150 and value(T.render_dpi, None) == 200
    assert [value(T.text_quality, t) for t in ("x" * 201, "x", "  ", None)] == ["clean", "degraded", "unreadable", "unreadable"]
    assert value(T.is_correction_page, "See ADDENDUM") and value(T.is_correction_page, "new fee is $12") and not value(T.is_correction_page, "plain") and not value(T.is_correction_page, None)
    assert value(T.is_absent_element, "No visible watermark") and not value(T.is_absent_element, "Round notary stamp") and not value(T.is_absent_element, None)


def test_small_expressions(value):
    assert value(T.normalize_key, " Loan-No. 1 ") == "loan_no_1"
    assert value(lambda c: T.coerce(c, ("high",), "medium"), "High") == "medium"
    assert value(T.display_name, "co_borrower_name") == "Co Borrower Name"
    assert value(lambda c: T.shorten(c, 3), "abcd") == "abc…" and value(lambda c: T.shorten(c, 3), "abc") == "abc"
    assert [value(T.error_class, t) for t in ("HTTP 429", "404", "unavailable", "bad API_KEY", "boom", None)] == ["rate limit", "model missing", "outage", "credentials", "other", "other"]
    assert value(lambda f, c: T.normalized_value(f, c), "prepaids", "$1,5") == {"kind": "money", "num": 15.0, "str": None}
    assert value(lambda f, c: T.normalized_value(f, c), "x", "") is None


@pytest.mark.parametrize(
    ("text", "a"),
    [('```json\n{"a": 1}\n```', 1), ('note {"a": 1} end', 1), ('{"a": 1', 1), ('{"a":1,"b":"tru', 1), ("", None), ("[1]", None), (None, None)],
)
def test_repaired_json(value, text, a):
    got = value(lambda c: T.repaired_json(c, "a int, b string"), text)
    assert (got or {}).get("a") == a


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("08/22/2O25", "2025-08-22"), ("1/26/25", "2025-01-26"), ("12-10-2025", "2025-12-10"), ("2025-10-02", "2025-10-02"), ("May 28, 2025", "2025-05-28"), ("28 Apr 2025", "2025-04-28"), (" 4 July 2025", "2025-07-04"),
        ("02/30/2025", None), ("13/01/2025", None), ("undated", None), ("", None), (None, None), ("Foo 3, 2025", None), ("0l/O5/2025", "2025-01-05"), ("2O25-05-16", "2025-05-16"),
    ],
)
def test_parse_day(value, text, day):
    assert value(K.parse_day, text) == (datetime.date.fromisoformat(day) if day else None)


def test_keys(value):
    assert value(K.clean_field_name, " Loan-Amount ") == "loan_amount" and value(K.clean_document_id, " 3D5FD421 ") == "3d5fd421"
    assert not value(K.is_usable, " N/A ") and not value(K.is_usable, "  ") and not value(K.is_usable, None) and value(K.is_usable, "0")
    assert [value(K.confidence_rank, c) for c in ("HIGH ", "medium", "Low", None, "?")] == [3, 2, 1, 0, 0]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


def test_dictionary_join_beyond_the_broadcast_bound(spark, monkeypatch):
    import paperloom.common as c

    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("salt"))
    names = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    small = sorted(map(tuple, c.join_dictionary(rows, names, ["k"]).collect()), key=str)
    monkeypatch.setattr(c, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(c.broadcast_if_small, "__defaults__", (0,))
    large = c.join_dictionary(rows, names, ["k"])
    assert sorted(map(tuple, large.select("k", "salt", "v").collect()), key=str) == small
