from decimal import Decimal

import pytest

from paperloom.operators import units as U


@pytest.mark.parametrize(
    ("text", "x", "unit"),
    [
        ("approx. US$ 1,234.5 thousand", "1234.5", "thousand"), ("5 3/8%", "5.375", "%"), ("1/2 acre", "0.5", "acre"), ("Thirty (30) yrs", "30", "yrs"), ("thirty years", "30", "years"), ("twenty-five years", "25", "years"),
        ("71 800 000 cents", "71800000", "cents"), ("$526 (000s)", "526", "000s"), ("$526", "526", ""), ("USD 500", "500", "usd"), ("802,00O US dollars", "802000", "us dollars"), ("1048SqFt", "1048", "sqft"), ("30Oyr", "300", "yr"), ("3OY", "30", "y"), ("24OK", "240", "k"),
        ("25-year fixed", "25", "year fixed"), ("138.3 yd²", "138.3", "yd2"), ("0.0725 as a fraction of one", "0.0725", "as a fraction of one"), ("Other", None, None), (None, None, None), ("4/0 ac", None, "ac"), ("~3 358 sq. ft.", "3358", "sq ft"),
    ],
)
def test_read_quantity(value, text, x, unit):
    got = value(U.read_quantity, text)
    assert got["value"] == (Decimal(x) if x else None)
    assert unit is None or got["unit"] == unit


@pytest.mark.parametrize(
    ("text", "unit"),
    [
        ("table caption: all entries in %, row shows 5.5.", "%"), ("units row: dollars", "dollars"), ("Units row: feet squared.", "feet squared"), ("sketch legend gives $000s", "000s"), ("entry 6.25, stated in % above the row", "%"),
        ("column headed in metric, sq m; figure read as 9", "metric sq m"), ("margin note says the entry 3O5 is in a fraction of one", "fraction of one"), ("garage of 41 m² not included", None), ("basement 600 sq ft excluded", None), (None, None),
    ],
)
def test_said_unit(value, text, unit):
    assert value(U.said_unit, text) == unit


def test_edit_cost_is_a_weighted_distance():
    assert U.edit_cost("sq ft", "sq ft") == 0 and U.edit_cost("squre feet", "square feet") < 1 < U.edit_cost("acre", "quart")
    assert U.edit_cost("ab", "") == U.edit_cost("", "ab")


def test_spellings_near_and_far(spark):
    d = spark.createDataFrame([("area", "squre feet"), ("area", "hectarse"), ("area", "dollars"), ("money", "dollrs"), ("money", "m"), ("area", "sq m")], "quantity string, unit string")
    got = {(r.quantity, r.unit): r.unit_code for r in U.map_spellings(d, U.UNIT_NAMES).collect()}
    assert got == {("area", "squre feet"): "sq_ft", ("area", "hectarse"): "hectare", ("money", "dollrs"): "usd", ("money", "m"): "musd", ("area", "sq m"): "sq_m"}


def tables(spark, rows):
    values = spark.createDataFrame(rows, "fv_id long, field string, raw_value string, normalized_value string, evidence string, feed string, Salt string")
    measured = spark.createDataFrame([("loan_amount", "money"), ("site_area", "area")], "field string, quantity string")
    unit = spark.createDataFrame([("usd", "money", 1.0, "usd"), ("kusd", "money", 1000.0, "usd"), ("sq_m", "area", 10.76391, "sq_ft"), ("sq_ft", "area", 1.0, "sq_ft")], "unit_code string, quantity string, to_common double, common_unit string")
    feeds = spark.createDataFrame([("ledger", "sq_m", "kusd"), ("scan", "sq_ft", "usd")], "feed string, area_unit string, money_unit string")
    return values, measured, unit, feeds


def test_order_of_sources(spark):
    rows = [
        (1, "Loan Amount", "$526", None, None, "ledger", ""), (2, "loan-amount", "$526 dollars", None, "units row: $000s", "ledger", ""), (3, "loan_amount", "526", None, "units row: dollars", "ledger", ""), (4, "site_area", "180.9", "1", None, "ledger", ""),
        (5, "site_area", "N/A", "12", None, "scan", ""), (6, "site_area", None, None, None, None, ""), (7, "other", "5", None, None, "scan", ""), (8, "site_area", "10 sq m", None, None, None, ""), (8, "site_area", "10 sq m", None, None, None, ""),
        (9, "site_area", "10", None, None, None, ""),
    ]
    out, aliases = U.standardize(*tables(spark, rows))
    got = {r.fv_id: r for r in out.collect()}
    assert [got[i].unit_code for i in (1, 2, 3, 4, 5)] == ["kusd", "usd", "usd", "sq_m", "sq_ft"]
    assert [got[i].unit_from for i in (1, 2, 3, 4)] == ["feed", "value", "evidence", "feed"]
    assert got[1].common_milli == 526_000_000 and got[4].common_milli == 1947191 and got[5].number_from == "normalized_value"
    assert 7 not in got and got[6].common_milli is None and got[9].unit_code is None and out.where("fv_id = 8").count() == 2
    assert {r.fv_id for r in U.converted(out).collect()} == {1, 4, 8} and aliases.count() == 3


def test_empty(spark):
    out, aliases = U.standardize(*tables(spark, []))
    assert out.count() == 0 and aliases.count() == 0


def test_long_remark_is_no_unit(spark):
    remark = "dollars " + "as the appraiser wrote on the margin of the form " * 40
    spelled = spark.createDataFrame([("money", remark.strip()), ("money", "dolars")], "quantity string, unit string")
    got = U.map_spellings(spelled, {"money": {"USD": ["dollars"]}}).collect()
    assert [r.unit for r in got] == ["dolars"]
