"""Numbers as catalogues print them. Text that isn't a number is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

NUMBER = r"[0-9]+[.,]?[0-9]*"


_PLAIN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _double(c: Column, shape: str = f"^({_PLAIN})$") -> Column:
    """A cast that takes plain decimal text only (no 'NaN', 'Infinity' or type suffix). The text is named once."""
    return F.regexp_extract(c, shape, 1).try_cast("double")


def parse_number(c: Column) -> Column:
    """Decimal comma or dot; blanks, no-break spaces and a trailing dot don't count."""
    return _double(F.translate(c, ",  ", "."), rf"^({_PLAIN})\.?$")


def parse_number_rich(c: Column) -> Column:
    """Takes off marks like ~ and >, reads thousand commas and exponents, the first of a range, the numerator, the first
    of several numbers, and drops units; text that starts with two letters is null."""
    bare = lambda s: F.when(s.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    numerator = lambda x: F.when(x.contains("/"), F.trim(F.split(x, "/", 2)[0])).otherwise(x)
    single = lambda x: F.when(x.rlike(r"^[\d.]*\d[\d.]*(\s+[\d.]*\d[\d.]*)+$"), F.split(x, r"\s+", 2)[0]).otherwise(x)

    def number(s: Column) -> Column:
        scientific = s.rlike("[eE]") & s.rlike(r"\d")
        large = bound(_double(s), lambda x: F.when(F.abs(x) <= 1e6, x))
        first = bound(bound(F.trim(F.split(s, "[-–—~…]", 2)[0]), numerator), single)
        return F.when((s == "") | s.rlike("^[A-Za-zА-Яа-я]{2}"), None).when(scientific, large).otherwise(_double(F.regexp_replace(first, r"[^\d.]", "")))

    return bound(bound(F.regexp_replace(F.trim(c), "^[~>< ≈≥≤]+", ""), bare), lambda s: bound(F.translate(s, ",", "."), number))


def parse_broken_number(c: Column) -> Column:
    """'1 .1' is 1.1, '1 3' is 13, '11,8' is 11.8; of 'a+b' the first counts."""
    s = F.trim(F.split(F.trim(c), r"\+", 2)[0])
    s = F.regexp_replace(s, r"(\d)\s+\.(\d)", "$1.$2")
    s = F.regexp_replace(s, r"(\d\.)\s+(\d)", "$1$2")
    s = F.regexp_replace(s, r"(\d)\s+(?=\d)", "$1")
    return _double(F.trim(F.translate(s, ",", ".")))


def parse_slash_number(c: Column) -> Column:
    """'1-phase / 3-phase': the second if it is positive, else the first if that is."""
    s = F.trim(c)
    parts = F.split(s, "/", 2)
    positive = lambda number: bound(number, lambda x: F.when(x > 0, x))
    pair = F.coalesce(positive(parse_number(F.try_element_at(parts, F.lit(2)))), positive(parse_number(F.element_at(parts, 1))))
    return F.when(s.contains("/"), pair).otherwise(parse_number(s))


_UNIT_END = r"(?iu)\s*(m³/h|m3/h|m/h|l/s|l/min|gpm|м³/ч|л/с|л/мин|m|м|ft|bar|бар|kw|квт|hp|kpa|кпа|psi)\s*$"


def parse_range(c: Column) -> Column:
    """struct(low, high): 'a-b' in order, one number twice, anything else 0 and 0."""
    s = F.regexp_replace(F.translate(F.trim(c), ",", "."), _UNIT_END, "")
    pattern = r"^([\d.]+)\s*[-–—]\s*([\d.]+)"
    a, b = (_double(F.regexp_extract(s, pattern, i)) for i in (1, 2))
    one = F.coalesce(_double(F.trim(s)), F.lit(0.0))
    pair = F.coalesce(s.rlike(pattern), F.lit(False))
    return F.struct(F.when(pair, F.least(a, b)).otherwise(one).alias("low"), F.when(pair, F.greatest(a, b)).otherwise(one).alias("high"))


def range_mid(c: Column) -> Column:
    r = parse_range(c)
    return (r["low"] + r["high"]) / 2


def numbers_in(c: Column) -> Column:
    """array<double>: the different numbers of a text."""
    found = F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.translate(x, ",", ".").try_cast("double")))


def half_up(c: Column, places: int) -> Column:
    """Rounded with halves up, in the arithmetic of doubles, so that every engine gives the same."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale
