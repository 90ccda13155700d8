"""Key and scalar clean-up expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value", compared in lower case without outer blanks.
PLACEHOLDERS = ("", "-", "--", "null", "none", "nil", "n/a", "na", "n.a.", "not applicable", "unknown", "undated", "tbd", "?")

#: Misread characters inside a run of digits.
MISREAD_FROM, MISREAD_TO = "OolI|SB", "0011158"

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def strip(c: Column) -> Column:
    """Without outer white space of any kind (trim() alone knows only blanks)."""
    return F.regexp_replace(c, r"(?U)^[\s\p{Zs}\x{FEFF}]+|[\s\p{Zs}\x{FEFF}]+$", "")


def clean_document_id(c: Column) -> Column:
    return F.lower(strip(c))


def clean_field_name(c: Column) -> Column:
    """snake_case: lower case, each run of other characters one underscore, none outside."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def is_usable(c: Column) -> Column:
    """True where a text holds a value: not null, not blank, not a placeholder."""
    return c.isNotNull() & ~F.lower(strip(c)).isin(*PLACEHOLDERS)


def fix_digits(c: Column) -> Column:
    """Letters that were misread for digits, where the text is otherwise a number or date."""
    return F.translate(c, MISREAD_FROM, MISREAD_TO)


def parse_day(c: Column) -> Column:
    """The calendar day that a text names, else null.

    Digits with slashes, dashes or dots are month first; yyyy-mm-dd, "May 28, 2025"
    and "28 Apr 2025" are read too.  Two-digit years are 20yy.  Misread digits are
    repaired first.  Impossible days (02/30) give null.
    """
    d = r"[0-9OolI|SB]"
    s = strip(c)
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)

    def ymd(y: Column, m: Column, day: Column) -> Column:
        return F.concat(year(y), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")

    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    num = lambda pattern, k: fix_digits(part(pattern, k))
    mdy = rf"^({d}{{1,2}})[/.\-]({d}{{1,2}})[/.\-]({d}{{4}}|{d}{{2}})$"
    iso = rf"^({d}{{4}})[/.\-]({d}{{1,2}})[/.\-]({d}{{1,2}})(?:[T ].*)?$"
    name_first = rf"^(?i:([a-z]{{3}})[a-z]*)\.? +({d}{{1,2}})(?i:st|nd|rd|th)?,? +({d}{{4}})$"
    day_first = rf"^({d}{{1,2}})(?i:st|nd|rd|th)?\.? +(?i:([a-z]{{3}})[a-z]*)\.?,? +({d}{{4}})$"
    month_no = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, f"{k:02d}")])
    of = lambda pattern, k: F.try_element_at(month_no, F.lower(part(pattern, k)))
    return (
        F.when(s.rlike(mdy), ymd(num(mdy, 3), num(mdy, 1), num(mdy, 2)))
        .when(s.rlike(iso), ymd(num(iso, 1), num(iso, 2), num(iso, 3)))
        .when(s.rlike(name_first), ymd(num(name_first, 3), of(name_first, 1), num(name_first, 2)))
        .when(s.rlike(day_first), ymd(num(day_first, 3), of(day_first, 2), num(day_first, 1)))
    )


def confidence_rank(c: Column) -> Column:
    """high 3, medium 2, low 1, anything else 0; spelling and blanks do not count."""
    s = F.lower(strip(c))
    return F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)
