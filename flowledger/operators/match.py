"""Joins of model names that are not quite equal, and records held against page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numbers_in
from .merge import prefixes

PARTS = r"^([A-Z]+)(\d.*)$"


def numeric_part_join(left: DataFrame, right: DataFrame, key: str = "key", order: str = "place") -> DataFrame:
    """key, other: for each left key the first right key (by order, then name) with the same part from its first digit on,
    of whose letters one is the start of the other. An equi join on that part; keys without letters and digits match none."""
    cut = lambda df, a, b: df.withColumns({a: F.regexp_extract(key, PARTS, 1), b: F.regexp_extract(key, PARTS, 2)}).where(F.col(b) != "")
    mine = cut(left.select(key).distinct(), "_a", "_n")
    theirs = cut(right.select(key, order), "_b", "_n").select(F.col(key).alias("other"), F.col(order).alias("_o"), "_b", "_n")
    found = mine.join(theirs, "_n").where(F.startswith("_a", "_b") | F.startswith("_b", "_a"))
    return found.groupBy(key).agg(F.min(F.struct("_o", "other"))["other"].alias("other"))


def key_variants(key: Column) -> Column:
    """array: the key without parentheses, with an F after its letters, and without one at their end."""
    s = F.regexp_replace(key, r"\(.*?\)", "")
    shape = r"^([A-Z]+?)(\d.*)$"
    base, rest = F.regexp_extract(s, shape, 1), F.regexp_extract(s, shape, 2)
    more = F.when(rest != "", F.concat(base, F.lit("F"), rest))
    less = F.when((rest != "") & F.endswith(base, F.lit("F")), F.concat(F.substring(base, F.lit(1), F.length(base) - 1), rest))
    return F.array_distinct(F.array_compact(F.array(s, more, less)))


def fuzzy_match(left: DataFrame, right: DataFrame, key: str = "key", order: str = "place") -> DataFrame:
    """key, other: the equal right key, else the first (by order, then name) that starts with a variant of the left key or is
    the start of one. Both are equi joins on exploded prefixes; empty keys match none."""
    mine = left.select(key).distinct().where(F.length(key) > 0)
    theirs = right.select(F.col(key).alias("other"), F.col(order).alias("_o")).where(F.length("other") > 0)
    equal = mine.join(theirs, mine[key] == theirs["other"]).select(key, "other").distinct()
    rest = mine.join(equal.select(key), key, "left_anti").withColumn("_v", F.explode(key_variants(F.col(key)))).where(F.length("_v") > 0)
    # the first right key of each prefix alone: a short left key has one row, not one for every longer name
    firsts = theirs.select(F.explode(prefixes(F.col("other"), 1)).alias("_v"), "_o", "other").groupBy("_v").agg(F.min(F.struct("_o", "other")).alias("_f"))
    longer = rest.join(firsts, "_v").select(key, F.col("_f.other").alias("other"), F.col("_f._o").alias("_o"))
    shorter = rest.select(key, F.explode(prefixes(F.col("_v"), 1)).alias("other")).distinct().join(theirs, "other")
    found = longer.select(key, "other", "_o").unionByName(shorter.select(key, "other", "_o"))
    return equal.unionByName(found.groupBy(key).agg(F.min(F.struct("_o", "other"))["other"].alias("other")))


def variant_fill(left: DataFrame, right: DataFrame, key: str = "key", value: str = "h", variant: str = r"T?-?BQCE$") -> DataFrame:
    """left with value, value_confidence and value_source: where it is missing (0 or null), from the right row of the key
    (.5, 'exact'), else from the left row of the key without its variant ending (.4, 'variant'; the greatest of several)."""
    known = lambda df, k, name: df.where(F.col(value) > 0).groupBy(k.alias("_k")).agg(F.max(value).alias(name))
    base = F.regexp_replace(F.col(key), variant, "")
    exact, same = known(right, F.col(key), "_exact"), known(left, base, "_same")
    out = left.join(exact, left[key] == exact["_k"], "left").drop("_k").withColumn("_base", base)
    out = out.join(same, out["_base"] == same["_k"], "left").drop("_k", "_base")
    lacks = F.coalesce(F.col(value), F.lit(0.0)) <= 0
    return out.withColumns({
        value: F.when(lacks, F.coalesce("_exact", "_same", F.col(value))).otherwise(F.col(value)),
        f"{value}_confidence": F.when(lacks & F.col("_exact").isNotNull(), 0.5).when(lacks & F.col("_same").isNotNull(), 0.4),
        f"{value}_source": F.when(lacks & F.col("_exact").isNotNull(), "exact").when(lacks & F.col("_same").isNotNull(), "variant"),
    }).drop("_exact", "_same")


def ocr_verified(text: Column, model: Column, value: Column, confidence: Column, low: float, high: float, agreement: float = 0.05) -> Column:
    """struct(value, confidence, source) of a value held against a page's numbers between low and high: surer by .3 (1 at most)
    where one agrees within a twentieth; a value of confidence .5 or less takes the nearest one (.7, 'ocr'). As it was where
    the page doesn't have the model's name (blanks and dashes don't count) or the value is missing."""
    bare = lambda x: F.regexp_replace(F.upper(x), r"[\s\-]", "")
    named = F.contains(bare(text), bare(model)) & (value > 0)
    fit = F.filter(numbers_in(text), lambda x: (x >= low) & (x <= high))
    agrees = F.exists(fit, lambda x: (x > 0) & (F.abs(x - value) / F.greatest(x, value) <= agreement))
    nearest = F.array_min(F.transform(fit, lambda x: F.struct(F.abs(x - value).alias("apart"), x.alias("x"))))["x"]
    row = lambda v, c, s: F.struct(v.alias("value"), c.alias("confidence"), F.lit(s).alias("source"))
    return F.when(named & agrees, row(value, F.least(F.lit(1.0), confidence + 0.3), "confirmed")).when(named & (confidence <= 0.5) & (nearest > 0), row(nearest, F.lit(0.7), "ocr")).otherwise(row(value, confidence, "unchanged"))


def text_confidence(text: Column, model: Column, values: list[Column]) -> Column:
    """.75 when a page has a part of the model's name (over two characters) and one of the values, .55 for either, else .35."""
    low = F.lower(text)
    named = F.exists(F.filter(F.split(model, r"[\s/\-]"), lambda x: F.length(x) > 2), lambda x: F.contains(low, F.lower(x)))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+[.,]\d+|\d+)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    found = F.lit(False)
    for v in values:
        written = v.cast("string")
        found = found | ((v != 0) & (F.array_contains(numbers, written) | F.contains(text, F.replace(written, F.lit("."), F.lit(",")))))
    named, found = F.coalesce(named, F.lit(False)), F.coalesce(found, F.lit(False))
    return F.when(named & found, 0.75).when(named | found, 0.55).otherwise(0.35)
