"""Quantities recorded in different units, into common units (problem 6).

Number and unit text of each row come out by JVM expressions.  The distinct unit
spellings, of which there are few for many rows, are mapped to known names: a character
n-gram inverted index proposes names, a weighted edit distance decides.  The alias
dictionary is then joined to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.common import cut, join_dictionary
from paperloom.functions import keys as K
from paperloom.rules.units import ROUGH, UNIT_NAMES

#: Edit distance, as a share of the longer text, up to which a spelling is a known name.
LIMIT = 0.2
#: Cost of an edit; pairs of characters that are easily misread cost less.
CHEAP_PAIRS = {frozenset(p) for p in ("0o", "1l", "1i", "il", "5s", "8b", "ec", "uv", "nm", "rn", "ft", "ao")}
DROP_COST = {" ": 0.1, ".": 0.05, "-": 0.1, "s": 0.4, "e": 0.7, "a": 0.7, "i": 0.7, "o": 0.7, "u": 0.7}

#: A digit, or a letter misread for one: further digits, a separator or the end follow, or a unit straight after O.
_DIGIT = r"(?:[0-9]|[OlISB|](?=[OlISB|]*(?:[0-9.,\s)%$¢]|$))|O(?=[a-z]|[KMY](?![A-Za-z])))"
_NUMBER = rf"{_DIGIT}+(?:,{_DIGIT}{{3}})+(?:\.{_DIGIT}+)?|{_DIGIT}{{1,3}}(?:[ \x{{A0}}\x{{202F}}]{_DIGIT}{{3}})+(?![0-9])(?:\.{_DIGIT}+)?|{_DIGIT}+(?:\.{_DIGIT}+)?|\.{_DIGIT}+"
_ROUGH = r"(?i)^(?:" + "|".join(x.replace(".", r"\.") for x in ROUGH) + r")\s*"
_MIXED = rf"^({_DIGIT}+)[ \-]+({_DIGIT}+)\s*/\s*({_DIGIT}+)(?![0-9/])"
_FRACTION = rf"^({_DIGIT}+)\s*/\s*({_DIGIT}+)(?![0-9/])"
_CURRENCY = r"(?i)^([+\-(]*\s*(?:us\s?\$|usd|us dollars?|\$)?)\s*"
_WORDED = r"^[A-Za-z][A-Za-z\- ]*\(\s*([0-9]+)\s*\)"


def number_words(limit: int = 100) -> dict[str, int]:
    """English words of the numbers from one to ``limit`` - 1, by rule."""
    ones = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    out = {w: k for k, w in enumerate(ones, 1)}
    for t, word in enumerate(tens, 2):
        out[word] = 10 * t
        out |= {f"{word}{sep}{ones[k - 1]}": 10 * t + k for k in range(1, 10) for sep in "- "}
    return {w: k for w, k in out.items() if k < limit}


def _spelling(c: Column) -> Column:
    """A unit text in the form in which spellings are compared."""
    s = F.translate(F.lower(c), "²³  _", "23   ")
    s = F.regexp_replace(s, r"[()\[\]:;,\"']", " ")
    s = F.regexp_replace(s, r"^\s*(?:in|of|an?)\s+|^[\s.\-/]+|[\s.\-/]+$", "")
    return F.regexp_replace(F.regexp_replace(s, r"[.\s]+", " "), r"^ | $", "")


def read_quantity(c: Column) -> Column:
    """struct<value decimal, unit string> of a text such as "approx. US$ 1,234.5 thousand".

    value is null if the text holds no number; unit is the spelling of what follows the
    number ("" if nothing), or the currency code before it.  A dollar sign alone is no
    unit.  Mixed fractions, number words and misread digits are read.
    """
    s = F.regexp_replace(K.strip(c), _ROUGH, "")
    half = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?<=[0-9])?\s*½", " 1/2"), r"\s*¼", " 1/4"), r"\s*¾", " 3/4")
    s = K.strip(F.when(s.rlike("[½¼¾]"), half).otherwise(s))
    money = F.regexp_extract(s, _CURRENCY, 1)
    rest = F.regexp_replace(s, _CURRENCY, "")
    dec = lambda x: F.regexp_replace(K.fix_digits(x), r"[,\s\x{A0}\x{202F}]", "").try_cast("decimal(24,8)")
    part = lambda pattern, k: F.regexp_extract(rest, pattern, k)
    ratio = lambda a, b: (dec(a) / F.when(dec(b) != 0, dec(b))).cast("decimal(24,8)")
    table = F.create_map(*[F.lit(x) for w, k in number_words().items() for x in (w, float(k))])
    spelled = r"^((?i:" + "|".join(sorted(number_words(), key=lambda w: -len(w))) + r"))\b"
    plain = rf"^(?=\.?[OlISB|]{{0,3}}\.?[0-9])({_NUMBER})"
    value = (
        F.when(rest.rlike(_MIXED), dec(part(_MIXED, 1)) + ratio(part(_MIXED, 2), part(_MIXED, 3)))
        .when(rest.rlike(_FRACTION), ratio(part(_FRACTION, 1), part(_FRACTION, 2)))
        .when(rest.rlike(plain), dec(part(plain, 1)))
        .when(rest.rlike(_WORDED), part(_WORDED, 1).try_cast("decimal(24,8)"))
        .when(rest.rlike(spelled), F.try_element_at(table, F.lower(part(spelled, 1))).cast("decimal(24,8)"))
    )
    sign = F.when(money.rlike(r"-") | (money.rlike(r"\(") & s.rlike(r"\)\s*$") & ~s.rlike(r"\(.*\(")), -1).otherwise(1)
    tail = F.when(rest.rlike(_MIXED), F.regexp_replace(rest, _MIXED, "")).when(rest.rlike(_FRACTION), F.regexp_replace(rest, _FRACTION, "")).when(rest.rlike(plain), F.regexp_replace(rest, plain, "")).when(rest.rlike(_WORDED), F.regexp_replace(rest, _WORDED, "")).otherwise(F.regexp_replace(rest, spelled, ""))
    unit = _spelling(tail)
    code = F.when(F.lower(money).rlike("us"), "usd").otherwise("")
    return F.struct((value * sign).cast("decimal(24,8)").alias("value"), F.when(unit != "", unit).otherwise(code).alias("unit"))


#: What a remark says before and after the unit in which its entry is given.
_SAID = r"(?i)\b(?:units?(?: row| column)?:|legend (?:gives|shows|says|reads)|(?:entries|entry|amounts?|figures?|values?|is|are|headed|stated|given|shown|expressed|reported|recorded|measured|all)(?: [0-9][0-9OlISB.,/ ]*)? in)\s+([^;]*?)\s*(?:$|;|\.$|,? (?:row|above|below|figure)\b)"


def said_unit(c: Column) -> Column:
    """Spelling of the unit that a remark names for its entry, else null.

    Units that stand by numbers of other things (a garage of 41 m2) don't count.
    """
    said = F.regexp_extract(c, _SAID, 1)
    return F.when(c.isNotNull() & (said != ""), F.regexp_replace(_spelling(said), r"^\$ ?", "")).otherwise(F.lit(None).cast("string"))


def edit_cost(a: str, b: str) -> float:
    """Weighted edit distance of two texts."""
    drop = lambda ch: DROP_COST.get(ch, 1.0)
    row = [0.0]
    for ch in b:
        row.append(row[-1] + drop(ch))
    for x in a:
        new = [row[0] + drop(x)]
        for j, y in enumerate(b):
            swap = 0.0 if x == y else 0.5 if frozenset((x, y)) in CHEAP_PAIRS else 1.0
            new.append(min(row[j] + swap, row[j + 1] + drop(x), new[j] + drop(y)))
        row = new
    return row[-1]


def _grams(c: Column) -> Column:
    """Distinct padded character trigrams, or the padded text if shorter."""
    s = F.concat(F.lit(" "), F.regexp_replace(c, r"[ .\-]", ""), F.lit(" "))
    n = F.greatest(F.length(s) - 2, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(3))))


def map_spellings(spellings: DataFrame, names: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """quantity, unit, unit_code, name, cost of each distinct (quantity, unit) near a known name.

    Spellings near none have no row.  Of equally near names the first in alphabetical
    order of code and name counts.
    """
    spark = spellings.sparkSession
    known = spark.createDataFrame([(q, code, n) for q, codes in names.items() for code, ns in codes.items() for n in ns], "quantity string, unit_code string, name string")
    index = F.broadcast(known.withColumn("g", F.explode(_grams(F.col("name")))))
    # the index is broadcast: it has the grams of the name list, whatever the data
    hits = spellings.withColumn("g", F.explode(_grams(F.col("unit")))).join(index, ["quantity", "g"])
    near = hits.groupBy("quantity", "unit", "unit_code", "name").agg(F.count(F.lit(1)).alias("shared"))
    near = near.where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.least(F.size(_grams(F.col("unit"))), F.size(_grams(F.col("name")))) * 0.3)))

    def share(a: str, b: str) -> float:
        if a == b:
            return 0.0
        longer = max(len(a), len(b))
        # what is longer than the name must at least be dropped; this spares very long texts the distance
        surplus = sorted(DROP_COST.get(ch, 1.0) for ch in a)[: max(0, len(a) - len(b))]
        return edit_cost(a, b) / longer if sum(surplus) <= LIMIT * longer + 1e-9 else 1.0

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p["cost"] = [share(a, b) for a, b in zip(p["unit"], p["name"], strict=True)]
            yield p[["quantity", "unit", "unit_code", "name", "cost"]][p["cost"] <= LIMIT]

    costed = near.mapInPandas(verify, "quantity string, unit string, unit_code string, name string, cost double")
    best = costed.groupBy("quantity", "unit").agg(F.min(F.struct("cost", "unit_code", "name")).alias("b"))
    return best.select("quantity", "unit", "b.unit_code", "b.name", "b.cost")


def standardize(values: DataFrame, measured: DataFrame, units: DataFrame, feeds: DataFrame, names: Mapping[str, Mapping[str, Sequence[str]]] = UNIT_NAMES) -> tuple[DataFrame, DataFrame]:
    """Every value of a measured field in the common unit of its quantity, and the alias dictionary.

    First frame: fv_id, field, quantity, raw_value, value, unit_code, unit_from (value,
    evidence, feed), common_unit, common_value decimal(38,8), common_milli bigint (halves
    away from zero).  What the value says goes before its evidence, that before the feed.
    A value whose unit text is near no known name takes the unit of its evidence or feed.
    If raw_value is null, blank or a placeholder, the number is that of normalized_value
    and number_from tells so.  Rows without a number, or without a unit anywhere, are
    kept with nulls.  Repeated rows stay; an empty table gives no rows.
    """
    spark = values.sparkSession
    fields = measured.select(K.clean_field_name(F.col("field")).alias("field"), "quantity").distinct()
    flat = values.select("fv_id", K.clean_field_name(F.col("field")).alias("field"), "raw_value", "normalized_value", "evidence", "feed")
    # the tables of fields, units and feeds are configuration; join_dictionary checks their size
    rows = join_dictionary(flat, fields, ["field"], "inner")
    usable = K.is_usable(F.col("raw_value"))
    rows = rows.withColumn("number_from", F.when(usable, "raw_value").when(K.is_usable(F.col("normalized_value")), "normalized_value"))
    rows = rows.withColumn("q", read_quantity(F.when(usable, F.col("raw_value")).when(K.is_usable(F.col("normalized_value")), F.col("normalized_value"))))
    rows = rows.select("fv_id", "field", "quantity", "raw_value", "feed", "number_from", F.col("q.value").alias("value"), F.when(F.col("q.unit") != "", F.col("q.unit")).alias("own"), said_unit(F.col("evidence")).alias("said"))
    spelled = rows.select("quantity", F.explode(F.array("own", "said")).alias("unit")).where("unit is not null and unit <> ''").distinct()
    aliases = cut(map_spellings(spelled, names))
    short = aliases.select("quantity", "unit", "unit_code")
    rows = join_dictionary(rows, short.select("quantity", F.col("unit").alias("own"), F.col("unit_code").alias("own_code")), ["quantity", "own"])
    rows = join_dictionary(rows, short.select("quantity", F.col("unit").alias("said"), F.col("unit_code").alias("said_code")), ["quantity", "said"])
    kinds = [c[: -len("_unit")] for c in feeds.columns if c.endswith("_unit")]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("quantity"), F.col(f"{k}_unit").alias("feed_code")) for k in kinds])) if kinds else None
    meant = feeds.select("feed", pairs.alias("p")).select("feed", "p.quantity", "p.feed_code").dropDuplicates(["feed", "quantity"]) if kinds else spark.createDataFrame([], "feed string, quantity string, feed_code string")
    rows = join_dictionary(rows, meant, ["feed", "quantity"])
    rows = rows.withColumn("unit_code", F.coalesce("own_code", "said_code", "feed_code")).withColumn("unit_from", F.when(F.col("own_code").isNotNull(), "value").when(F.col("said_code").isNotNull(), "evidence").when(F.col("feed_code").isNotNull(), "feed"))
    factor = units.select("unit_code", "quantity", F.col("to_common").cast("decimal(24,8)").alias("to_common"), "common_unit").dropDuplicates(["unit_code", "quantity"])
    rows = join_dictionary(rows, factor, ["unit_code", "quantity"])
    common = (F.col("value").cast("decimal(20,8)") * F.col("to_common").cast("decimal(17,8)")).cast("decimal(38,8)")
    out = rows.select(
        "fv_id", "field", "quantity", "raw_value", "number_from", "value", "unit_code", "unit_from", "common_unit",
        common.alias("common_value"), F.round(common * 1000, 0).try_cast("bigint").alias("common_milli"),
    )
    return out, aliases


def converted(out: DataFrame) -> DataFrame:
    """Rows of standardize() with a usable raw_value recorded in another unit than the common one."""
    kept = out.where((F.col("number_from") == "raw_value") & F.col("common_milli").isNotNull() & (F.col("unit_code") != F.col("common_unit")))
    return kept.select("fv_id", "unit_code", "common_milli")
