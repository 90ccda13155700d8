"""Scalar expressions on page text and field values; all of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.keys import strip
from paperloom.rules import mortgage as M


def _sub(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, "(?U)" + r[0], r[1]), rules, c)


def clean_text(c: Column, word_rules: bool = True) -> Column:
    """Text without noise signs, with misread digits and words mended, blank lines dropped, lines stripped.

    The word rules also change right words (closing disclosure -> closing disdosure); they
    can be left out.  Null and empty stay as they are.
    """
    s = _sub(c, [*M.NOISE_RULES, M.SPACE_RULE, *M.NUMBER_RULES, *(M.WORD_RULES if word_rules else ())])
    lines = F.transform(F.split(s, r"\r\n|[\n\r\x{2028}\x{2029}]"), strip)
    return F.when(c.isNotNull(), F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def render_dpi(c: Column) -> Column:
    return F.when(F.length(strip(F.coalesce(c, F.lit("")))) < 80, 200).otherwise(150)


def text_quality(c: Column) -> Column:
    n = F.length(strip(F.coalesce(c, F.lit(""))))
    return F.when(n > 200, "clean").when(n > 0, "degraded").otherwise("unreadable")


def has_degraded_text(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) < 100


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Whether one of the phrases stands in the text, in either case; null is no."""
    return F.coalesce(c, F.lit("")).rlike("(?i)" + "|".join(re.sub(r"([.*+?()\[\]{}|\\^$/])", r"\\\1", p) for p in phrases))


def is_correction_page(c: Column, keywords: Sequence[str] = M.CORRECTION_KEYWORDS, value: str = M.CORRECTION_VALUE) -> Column:
    s = F.coalesce(c, F.lit(""))
    return contains_any(s, keywords) | s.rlike("(?i)" + value)


def is_absent_element(description: Column, phrases: Sequence[str] = M.NEGATIONS) -> Column:
    return contains_any(description, phrases)


def coerce(c: Column, allowed: Sequence[str], default: Column | str) -> Column:
    """The value if it is one of the allowed ones (case counts), else the default."""
    return F.when(c.isin(*allowed), c).otherwise(default if isinstance(default, Column) else F.lit(default))


def normalize_key(c: Column) -> Column:
    return F.translate(strip(F.lower(c)), " -.", "__")


def is_null_like(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(*M.NULL_LIKE)


def _filled(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def money(c: Column) -> Column:
    """Amount of a field value; brackets make it null, as they stay in the digits."""
    v = F.regexp_replace(F.regexp_replace(_filled(c), r"(?<=\d)O(?=\d)", "0"), r"(?<=\d)[Il](?=\d)", "1")
    cleaned = F.regexp_replace(v, r"[^\d.\-()]", "")
    negative = (v.contains("(") & v.contains(")")) | F.regexp_replace(v, r"^\s+", "").startswith("-")
    n = cleaned.try_cast("double")
    return F.when(negative, -F.abs(n)).otherwise(n)


def percent(c: Column) -> Column:
    """Number before the first percent sign; every O, I and l is a digit, signs are lost."""
    v = F.translate(F.substring_index(_filled(c), "%", 1), "OIl", "011")
    return F.regexp_replace(v, r"[^\d.]", "").try_cast("double")


_DAY = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"


def date_text(c: Column) -> Column:
    """MM/DD/YYYY of the first date in the text, without a calendar check; else the stripped text."""
    v = F.regexp_replace(_filled(c), r"(?<=\d)O(?=\d)", "0")
    part = lambda k: F.regexp_extract(v, _DAY, k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    made = F.concat_ws("/", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), year)
    return F.when(v.rlike(_DAY), made).otherwise(strip(_filled(c)))


def date_tuple(c: Column) -> Column:
    """struct<y,m,d> of the first d/d/y anywhere in the text, for ordering; null without one."""
    p = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
    part = lambda k: F.regexp_extract(c, p, k).try_cast("int")
    y = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    return F.when(c.rlike(p), F.struct(y.alias("y"), part(1).alias("m"), part(2).alias("d")))


def table_money(c: Column) -> Column:
    """Amount of a table cell: brackets around all of it make it negative."""
    s = strip(c)
    boxed = s.rlike(r"^\(.*\)$")
    n = F.regexp_replace(F.when(boxed, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s), r"[,$]", "")
    x = F.when(strip(n).rlike(r"^[+\-]?(\d+\.?\d*|\.\d+)$"), strip(n)).try_cast("double")
    return F.when(boxed, -F.abs(x)).otherwise(x)


def check_money(c: Column) -> Column:
    """Number for arithmetic checks: all but digits, points and minus signs is dropped."""
    s = strip(c)
    n = F.regexp_replace(s, r"[^\d.\-]", "").try_cast("double")
    return F.when(s.rlike(r"^\((?s:.*)\)$"), -F.abs(n)).otherwise(n)


def normalized_value(field: Column, c: Column) -> Column:
    """struct<kind,num,str>: money, percent, date or text, by field name and value."""
    f, v = F.lower(field), _filled(c)
    is_money = f.isin(*M.MONEY_FIELDS) | v.contains("$")
    is_percent = f.isin(*M.PERCENT_FIELDS) | v.endswith("%")
    kind = F.when(is_money, "money").when(is_percent, "percent").when(f.isin(*M.DATE_FIELDS), "date").otherwise("text")
    num = F.when(kind == "money", money(v)).when(kind == "percent", percent(v))
    text = F.when(kind == "date", date_text(v)).when(kind == "text", strip(v))
    return F.when(v.isNotNull(), F.struct(kind.alias("kind"), num.alias("num"), text.alias("str")))


def format_fails(field: Column, c: Column) -> Column:
    """The kind of format that a value of a known field misses, else null."""
    f, s = F.lower(field), strip(c)
    ok_money = F.translate(s, ",", "").rlike(r"^[+\-]?\(?\$?[\d,]+(?:\.\d{1,2})?\)?\s*$")
    ok_percent = s.rlike(r"^[+\-]?\d{1,3}(?:\.\d{1,6})?\s*%?\s*$")
    ok_date = s.rlike(r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    return F.when(f.isin(*M.MONEY_FIELDS) & bad(ok_money), "money").when(f.isin(*M.PERCENT_FIELDS) & bad(ok_percent), "percent").when(f.isin(*M.DATE_FIELDS) & bad(ok_date), "date")


def display_name(c: Column) -> Column:
    return F.initcap(F.translate(c, "_", " "))


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def error_class(c: Column) -> Column:
    """Class of a failure by the words of its message."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(s.rlike("429|quota|rate_limit"), "rate limit")
        .when(s.rlike("404|not_found"), "model missing")
        .when(s.rlike("503|unavailable"), "outage")
        .when(s.rlike("api_key|invalid|401|403"), "credentials")
        .otherwise("other")
    )


def document_key(path: Column) -> Column:
    """Eight hex digits that a path always gets."""
    return F.substring(F.sha2(path, 256), 1, 8)


def cache_key(model: Column, content: Column, prompt: Column) -> Column:
    """Key of a stored answer: model, content and prompt."""
    return F.concat_ws(":", F.lit("v4"), model, F.md5(content), F.md5(prompt))


def json_object(c: Column) -> Column:
    """The text of a response's JSON object: as it is, without fences, its outermost braces, then repairs of a cut end.

    The repairs, of the outermost braces first, add two or one closing braces, at the end or
    before the last comma; null if nothing parses, also for a JSON that is no object.
    """

    def repairs(t: Column) -> list[Column]:
        # without a comma all of it is the head
        head = F.regexp_replace(t, r"(?s),[^,]*$", "")
        return [F.concat(t, F.lit("}}")), F.concat(t, F.lit("}")), F.concat(head, F.lit("}")), F.concat(head, F.lit("}}"))]

    is_object = lambda t: t.startswith("{") & F.try_parse_json(t).isNotNull()
    bare = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    repaired = lambda s, outer: F.get(F.filter(F.array(*repairs(outer), *repairs(s)), is_object), F.lit(0))
    read = lambda s, outer: F.coalesce(F.when(is_object(s), s), F.when(is_object(outer), outer), repaired(s, outer))
    return _let(bare, lambda s: _let(F.regexp_extract(s, r"(?s)\{.*\}", 0), lambda outer: read(s, outer)))


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that it needs several times, made once."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def repaired_json(c: Column, schema: str) -> Column:
    """json_object() read by a schema; null without an object."""
    return F.from_json(json_object(c), schema)
