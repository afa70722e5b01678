"""Filters, worklists and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import hydraulic_kw

Range = tuple[float | None, float | None]


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(entries: DataFrame, like: dict[str, str] | None = None, min_confidence: float = 0.0, has_curve: bool | None = None, limit: int = 100, offset: int = 0, order: tuple[str, ...] = ("model", "seq"), wildcards: bool = False, **ranges: Range) -> DataFrame:
    """One page of the matching records in order, each with the total number of matches.

    like: column -> text that it must contain, in any case (wildcards: % and _ in it stay wild). Other arguments are column
    -> (least, greatest), either of which may be None.
    """
    where = F.col("confidence") >= min_confidence if min_confidence > 0 else F.lit(True)
    for name, (low, high) in ranges.items():
        if low is not None:
            where = where & (F.col(name) >= low)
        if high is not None:
            where = where & (F.col(name) <= high)
    for name, text in (like or {}).items():
        where = where & F.col(name).ilike(f"%{text if wildcards else escaped(text)}%")
    if has_curve is not None:
        curve = F.coalesce((F.size("q_points") > 0) & (F.size("h_points") > 0), F.lit(False))
        where = where & (curve if has_curve else ~curve)
    found = entries.where(where)
    page = found.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


def keyword_search(models: DataFrame, words: list[str], columns: list[str], order: list[str], limit: int = 5) -> DataFrame:
    """The first models, in order, of which a column contains any word of over two letters."""
    own = [w.lower() for w in words if len(w) > 2]
    hit = F.lit(False)
    for c in columns:
        for w in own:
            hit = hit | F.lower(c).contains(w)
    return models.where(hit).orderBy(*order).limit(limit)


def spot_check(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by the order of a hash of their key: random, but the same each time."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def source_score() -> Column:
    """Points for the kind of source, known head and power, and confidence."""
    by_source = F.when(F.col("data_source") == "catalog_curve", 4).when(F.col("data_source") == "catalog_nominal", 2).when(F.col("data_source").isin("universal_table", "universal_qh_matrix"), 1).otherwise(0)
    return by_source + F.when(F.col("h_nom") > 0, 2).otherwise(0) + F.when(F.col("power_kw") > 0, 1).otherwise(0) + F.floor(F.col("confidence") * 2).cast("int")


def reset_impossible(entries: DataFrame, q_max: float = 2000, h_max: float = 1000, p_max: float = 500, ratio: float = 3.0) -> DataFrame:
    """Values over a limit set all three to zero; a hydraulic power of over ratio times the power sets flow and head to zero."""
    q, h, p = F.col("q_nom"), F.col("h_nom"), F.col("power_kw")
    wild = (q > q_max) | (h > h_max) | (p > p_max)
    odd = (p > 0) & (q > 0) & (h > 0) & (hydraulic_kw(q, h) / p > ratio)
    zero = lambda c, when: F.when(when, 0.0).otherwise(c)
    return entries.withColumns({"q_nom": zero(q, wild | odd), "h_nom": zero(h, wild | odd), "power_kw": zero(p, wild)})


def gap_worklist(entries: DataFrame, columns: list[str], page: str = "source_page") -> DataFrame:
    """A row for each missing value (0 or null) of a record on a known page: the record's columns and missing."""
    lacks = F.array_compact(F.array(*(F.when(F.coalesce(F.col(x), F.lit(0)) == 0, x) for x in columns)))
    return entries.where(F.col(page) >= 0).withColumn("missing", F.explode(lacks))
