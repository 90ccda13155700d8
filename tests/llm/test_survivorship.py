import datetime as dt
import random

from paperloom.llm.queries import SURVIVING
from paperloom.llm.survivorship import field_value_survivors, survivor_rows

SCHEMA = "fv_id long, document_id string, field string, raw_value string, evidence string, confidence string, correction_date string, source_page int, captured_at timestamp, K0 string, n string"
T0 = dt.datetime(2025, 1, 1)


def brute(rows):
    conf = {"high": 3, "medium": 2, "low": 1}
    ph = {"", "-", "null", "none", "n/a", "not applicable", "undated"}

    def day(s):
        try:
            return dt.datetime.strptime(s.strip(), "%m/%d/%Y").date()
        except (ValueError, AttributeError):
            return None

    groups = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups.setdefault((r[1].strip().lower(), r[2].strip().lower().replace(" ", "_").replace("-", "_")), []).append(r)
    out = set()
    for (d, f), rs in groups.items():
        if len(rs) < 2:
            continue
        rs = sorted(rs, key=lambda r: (-conf.get((r[5] or "").strip().lower(), 0), -(day(r[6]) or dt.date(1, 1, 1)).toordinal(), -(r[7] if r[7] is not None else -1), -(r[8] - T0).total_seconds() if r[8] else 1, r[0]))
        for name, at in (("raw_value", 3), ("evidence", 4), ("correction_date", 6)):
            for r in rs:
                v = r[at]
                if v is not None and v.strip().lower() not in ph and (at != 6 or day(v)):
                    out.add((d, f, name, r[0]))
                    break
    return out


def test_against_brute_force(spark):
    rnd = random.Random(7)
    pick = rnd.choice
    rows = [
        (i, pick(["ab", " AB ", "cd", None, "ef"]), pick(["Loan Type", "loan_type", "loan-type", "nmls", None]), pick([None, "", "  ", "x", "N/A", "y" * 5000]), pick([None, "-", "seen", "other"]), pick(["high", "HIGH ", "Medium", "low", None, "?"]),
         pick([None, "undated", "02/30/2025", "01/31/2025", "12/01/2024"]), pick([None, 1, 2, 3]), pick([None, T0, T0 + dt.timedelta(days=1)]), "clash", None)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in survivor_rows(field_value_survivors(df), SURVIVING).collect()}
    assert got == brute(rows)
    # order of the rows doesn't matter
    rnd.shuffle(rows)
    assert {tuple(r) for r in survivor_rows(field_value_survivors(spark.createDataFrame(rows, SCHEMA).repartition(5)), SURVIVING).collect()} == got


def test_empty_and_single(spark):
    one = spark.createDataFrame([(1, "a", "f", "x", None, None, None, None, None, "", "")], SCHEMA)
    assert field_value_survivors(one).count() == 0 and field_value_survivors(one.limit(0)).count() == 0
    twice = field_value_survivors(one.union(one)).first()
    assert twice.n_records == 2 and twice.raw_value.row_id == 1 and twice.evidence is None
