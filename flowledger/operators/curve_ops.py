"""Curves between their long form (a row for each point) and arrays, and checks on points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_arrays(points: DataFrame, by: list[str], q: str = "q", h: str = "h") -> DataFrame:
    """One row for each curve: q_points and h_points in order of flow."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(q).alias("q"), F.col(h).alias("h"))))
    return points.groupBy(*by).agg(ordered.alias("p")).select(*by, F.transform("p", lambda x: x["q"]).alias("q_points"), F.transform("p", lambda x: x["h"]).alias("h_points"))


def to_points(curves: DataFrame, by: list[str]) -> DataFrame:
    return curves.select(*by, F.inline(F.arrays_zip(F.col("q_points").alias("q"), F.col("h_points").alias("h"))))


def drop_jumps(points: DataFrame, by: str, share: int = 3, rise: float = 5, drop: float = 10) -> DataFrame:
    """Without the points whose head jumps by over drop, in models of three points or more where over a share-th of the
    points rise by over rise."""
    order = Window.partitionBy(by).orderBy("q")
    whole = Window.partitionBy(by)
    before = points.withColumn("_before", F.lag("h").over(order))
    counted = before.withColumns({"_n": F.count("*").over(whole), "_rises": F.count_if(F.col("h") > F.col("_before") + rise).over(whole)})
    odd = (F.col("_n") >= 3) & (F.col("_rises") > F.floor(F.col("_n") / share)) & F.coalesce(F.col("h") > F.col("_before") + drop, F.lit(False))
    return counted.where(~odd).drop("_before", "_n", "_rises")


def header_zero(q_values: Column, known: Column) -> Column:
    """A leading flow of 0 is a header if the next flow is over 30 and the series isn't known to start at 0."""
    return F.coalesce((F.get(q_values, F.lit(0)) == 0) & (F.get(q_values, F.lit(1)) > 30) & ~known, F.lit(False))


def is_metadata(q: Column, h: Column, inlets: list[float], motors: list[float]) -> Column:
    """A flow that is an inlet size with a head that is a motor size: a row of sizes taken for a point."""
    return F.coalesce(q.isin(inlets) & h.isin(motors), F.lit(False))


def within_limits(points: DataFrame, limits: DataFrame, by: str, h_max: float = 600) -> DataFrame:
    """Points with flow and head over 0, head up to h_max and flow between low and high of their key."""
    return points.join(limits, by).where((F.col("q") > 0) & (F.col("h") > 0) & (F.col("h") <= h_max) & F.col("q").between(F.col("low"), F.col("high")))
