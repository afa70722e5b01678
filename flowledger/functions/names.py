"""Model names: keys, series and clean forms. Each normaliser is a rule of its own; none replaces another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic capitals that look like Latin ones.
CYRILLIC, LATIN = "АВЕКМНОРСТХ", "ABEKMHOPCTX"
SERIES_LETTERS = "A-ZА-ЯЁa-zа-яё"


def model_key(name: Column) -> Column:
    """'CDM 32-5', 'CDM32-5', 'cdm 32-5' and 'CDM-32-5' have one key."""
    s = F.translate(F.upper(F.trim(name)), CYRILLIC, LATIN)
    for pattern, by in (
        (r"\s*(50|60)\s*HZ\s*$", ""),
        (r"\s*\(IE[1-4]\)\s*$", ""),
        (r"(/\d)T$", "$1"),
        (r"\s*[-–—]\s*", "-"),
        (r"\s*/\s*", "/"),
        (r"[\s_]+", ""),
        (r"([A-Z])-(\d)", "$1$2"),
    ):
        s = F.regexp_replace(s, pattern, by)
    return s


def plain_key(name: Column) -> Column:
    """Upper case without blanks and parentheses, decimal comma as dot, Cyrillic letters as Latin ones."""
    s = F.regexp_replace(F.upper(F.trim(name)), r"\s+", "")
    return F.translate(s, "МВСЕНОРТА,()", "MBCEHOPTA.")


def catalogue_key(name: Column) -> Column:
    """Drops '.0' parts and blanks before numbers, Cyrillic letters as Latin ones; keeps case."""
    s = F.regexp_replace(F.trim(name), r"\.0(?=[/\s-]|$)", "")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"([A-Za-zА-я])\s+(\d)", "$1$2")
    s = F.regexp_replace(F.translate(s, "МВСЕНОРТА,–—‒", "MBCEHOPTA.---"), "[​‌﻿]", "")
    return s


def base_key(name: Column) -> Column:
    """Upper case without blanks; two Cyrillic letters as Latin ones."""
    return F.translate(F.upper(F.trim(name)), "МВ​ ", "MB")


def repair_split_name(name: Column) -> Column:
    """Joins numbers that were torn apart: 'LVR(S)1 5-1' is 'LVR(S)15-1'."""
    s = F.regexp_replace(F.trim(name), r"(\d)\s+(-\d)", "$1$2")
    for _ in range(3):
        s = F.regexp_replace(s, r"(-\d+)\s+(\d)", "$1$2")
    s = F.regexp_replace(s, r"(\))\s*(\d)\s+(\d)", "$1$2$3")
    s = F.regexp_replace(s, r"(?<=\d)\s+(?=\d+[-])", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean_name(name: Column) -> Column:
    """Cyrillic look-alikes of both cases as Latin letters, footnote stars off."""
    return F.regexp_replace(F.translate(F.trim(name), CYRILLIC + CYRILLIC.lower(), LATIN + LATIN.lower()), r"\*+$", "")


def series_of(name: Column) -> Column:
    """The leading 2 to 6 letters in upper case; empty without them."""
    return F.upper(F.regexp_extract(F.trim(name), f"^([{SERIES_LETTERS}]{{2,6}})", 1))


def word_series_of(name: Column) -> Column:
    """Leading letters, with a second group of letters after a blank or dash."""
    return F.regexp_replace(F.trim(F.regexp_extract(F.trim(name), f"^([{SERIES_LETTERS}]{{2,}}(?:[\\s\\-]?[{SERIES_LETTERS}]+)?)", 1)), "-+$", "")


def prepend_series(name: Column, series: Column) -> Column:
    """A name that starts with a digit gets its page's series before it."""
    return F.when(name.rlike(r"^\d"), F.concat(series, F.lit(" "), name)).otherwise(name)


def orientation(series: Column, horizontal: list[str]) -> Column:
    return F.when(F.upper(series).isin(horizontal), "horizontal").otherwise("vertical")


# Parts of names that are no models.
GARBAGE_WORDS = ["конструкция", "aisi", "astm", "таблица", "содержание", "чугун", "бронза", "сталь", "фирменная", "табличка", "описание", "description", "applications", "применение", "материал", "material"]
GARBAGE_STARTS = ["вт ", "npsh", "dn", "in ", "ll ", "dh ", "ye", "сч", "вч"]


def is_garbage(name: Column) -> Column:
    """True for text fragments, bare numbers and unit scraps that were taken for a model name. Null counts as garbage."""
    s = F.trim(name)
    low = F.lower(s)
    tokens = F.split(s, r"\s+")
    modelish = F.size(F.filter(tokens, lambda t: t.rlike("^[A-ZА-ЯЁ]{2,}[0-9]")))
    bad = (
        (F.length(s) < 3)
        | ~s.rlike("[0-9]")
        | ~s.rlike(rf"^[{SERIES_LETTERS}]{{2,}}[\s\-_]?[0-9]")
        | low.rlike("|".join(GARBAGE_WORDS))
        | low.rlike(f"^({'|'.join(GARBAGE_STARTS)})")
        | ((F.size(tokens) >= 3) & (modelish >= 2))
        | s.rlike(r"[0-9]\.\s+[A-ZА-ЯЁ]")
        | (F.length(s) > 40)
    )
    return F.coalesce(bad, F.lit(True))


def natural_sort_key(name: Column) -> Column:
    """array<string> that orders LVR2 before LVR10: digit runs padded to 12."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(F.lower(p)))
