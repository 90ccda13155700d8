"""Names of units, as plain data."""

#: Quantity -> unit code -> names that sources use.  Spellings near one of
#: these are mapped to it; singulars, plurals, points and blanks need no entry of their own.
UNIT_NAMES = {
    "area": {
        "sq_ft": ["square feet", "square foot", "sq ft", "sqft", "sf", "ft2", "feet squared"],
        "sq_m": ["square metres", "square meters", "sq metres", "sq meters", "sq m", "sqm", "m2", "metres squared", "metric sq m"],
        "sq_yd": ["square yards", "square yard", "sq yd", "sqyd", "yd2", "yards squared"],
        "acre": ["acres", "acre", "ac"],
        "hectare": ["hectares", "hectare", "ha", "hect"],
    },
    "duration": {
        "month": ["months", "month", "mo", "mos", "mths", "mth"],
        "year": ["years", "year", "yr", "yrs", "y", "year fixed"],
        "quarter": ["quarters", "quarter", "qtr", "qtrs", "quarterly periods", "quarter years", "three-month periods"],
    },
    "rate": {
        "percent": ["percent", "per cent", "pct", "%", "percentage"],
        "bps": ["basis points", "basis point", "bps", "bp"],
        "fraction": ["decimal", "decimal fraction", "fraction", "fraction of one", "as a fraction of one"],
    },
    "money": {
        "usd": ["dollars", "us dollars", "whole dollars", "usd"],
        "kusd": ["thousand", "thousands", "thousand dollars", "thousands of dollars", "k", "000s", "000"],
        "musd": ["million", "millions", "million dollars", "millions of dollars", "mm", "m", "mio", "mn"],
        "cent": ["cents", "cent", "c", "¢", "whole cents"],
    },
}

#: Words before a number that call it rough.
ROUGH = ("approximately", "approx.", "approx", "circa", "ca.", "about", "abt.", "abt", "roughly", "~", "≈")
