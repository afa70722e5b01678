"""Units of flow (m³/h), head (m) and power (kW)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to m³/h, m and kW.
FACTORS = {
    "q": {
        "м³/ч": 1.0, "m³/h": 1.0, "m3/h": 1.0, "m^3/h": 1.0, "м3/ч": 1.0, "куб.м/ч": 1.0, "cbm/h": 1.0, "м3/час": 1.0, "м3 /час": 1.0, "m3/час": 1.0,
        "л/с": 3.6, "l/s": 3.6, "л/мин": 0.06, "l/min": 0.06, "gpm": 0.2271, "usgpm": 0.2271, "igpm": 0.2728, "м³/мин": 60.0, "m³/min": 60.0,
        "м": 1.0, "м/ч": 1.0, "m/h": 1.0, "куб.м./ч": 1.0, "куб. м/ч": 1.0, "куб м/ч": 1.0,
    },
    "h": {
        "м": 1.0, "m": 1.0, "м.в.ст": 1.0, "mwc": 1.0, "mws": 1.0, "ft": 0.3048, "feet": 0.3048, "бар": 10.197, "bar": 10.197, "atm": 10.33,
        "кпа": 0.10197, "kpa": 0.10197, "мпа": 101.97, "mpa": 101.97, "psi": 0.7031,
    },
    "p": {"квт": 1.0, "kw": 1.0, "вт": 0.001, "w": 0.001, "л.с.": 0.7457, "hp": 0.7457, "cv": 0.7355, "ps": 0.7355},
}
PER_MINUTE = 1 / 60  # litres a minute to m³/h by the repair stage, which doesn't round to 0.06


def convert(value: Column, unit: Column, kind: str) -> Column:
    """value in the standard unit of kind q, h or p. An unknown or null unit has factor 1."""
    factors = F.create_map(*(F.lit(x) for x in chain.from_iterable(FACTORS[kind].items())))
    return value * F.coalesce(factors[F.lower(F.trim(unit))], F.lit(1.0))


# How headers write units, tried in this order.
HEADER_UNITS = {
    "q": {
        "m3/h": [r"м[³3]\s*/\s*ч", r"m[³3]\s*/\s*h", r"m3\s*/\s*h", r"mc/h", r"куб\.?\s*м/ч", r"cbm/h", r"м3\s*/?\s*час"],
        "l/min": [r"л\s*/\s*мин", r"l\s*/\s*min", r"lpm"],
        "l/s": [r"л\s*/\s*с", r"l\s*/\s*s"],
        "gpm": [r"gpm", r"gal\s*/\s*min", r"usgpm"],
    },
    "h": {
        "m": [r"м\.?\s*в\.?\s*ст\.?", r"mwc", r"m\.?\s*w\.?\s*c\.?", r"метр", r"\bм\b", r"\bm\b"],
        "ft": [r"\bft\b", r"feet", r"фут"],
        "bar": [r"бар", r"\bbar\b"],
        "kpa": [r"кпа", r"\bkpa\b"],
    },
    "p": {"kw": [r"квт", r"\bkw\b"], "hp": [r"л\.?\s*с\.?", r"\bhp\b", r"\bcv\b"], "w": [r"\bвт\b", r"\bwatt\b"]},
}


def unit_in(text: Column, kind: str) -> Column:
    """The first unit of kind that a text names, or null."""
    s = F.lower(text)
    return F.coalesce(*(F.when(s.rlike(f"(?U)(?:{'|'.join(patterns)})"), unit) for unit, patterns in HEADER_UNITS[kind].items()))


def detect_unit(headers: Column, page_text: Column, kind: str) -> Column:
    """The unit of kind: of the first header that names one in brackets or after a comma, else anywhere in the headers,
    else in the first 2000 characters of the page."""
    in_brackets = lambda h: unit_in(F.regexp_extract(h, r"[(\[](.*?)[)\]]", 1), kind)
    after_comma = lambda h: unit_in(F.regexp_extract(h, r",\s*(.+)$", 1), kind)
    each = F.filter(F.transform(headers, lambda h: F.coalesce(in_brackets(h), after_comma(h))), lambda u: u.isNotNull())
    return F.coalesce(F.try_element_at(each, F.lit(1)), unit_in(F.concat_ws(" ", headers), kind), unit_in(F.substring(page_text, 1, 2000), kind))
