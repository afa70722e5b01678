"""The ordered chain of gap fills: models take missing values from models that their names point to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

VALUES = ("q", "h", "kw")


def fill_key(name: Column) -> Column:
    """The key by which a name is looked up: capitals, decimal dot, no blanks or parentheses."""
    return F.regexp_replace(F.translate(F.upper(name), ",", "."), r"[\s()]+", "")


@dataclass(frozen=True)
class Fill:
    """One pass: names gives the other names of a model in the order in which they are tried (array<string>; nulls are left
    out), or frame the group whose first complete model gives. complete: only complete models give. lacking: only models that
    lack this value take, whatever else they lack."""

    source: str
    confidence: float
    names: Callable[[Column], Column] | None = None
    frame: Callable[[Column], Column] | None = None
    complete: bool = True
    values: tuple[str, ...] = VALUES
    lacking: str | None = None


def sibling_names(name: Column) -> Column:
    """With and without a '-2' at the end."""
    return F.array(F.when(name.endswith("-2"), F.trim(F.substring(name, F.lit(1), F.length(name) - 2))).otherwise(F.concat(name, F.lit("-2"))))


def phase_names(name: Column) -> Column:
    """'Fm32/160' and 'F 32/160': one phase and three."""
    single, three = r"^([A-Za-z]+?)m(\d.*)$", r"^([A-Za-z]+)\s+(\d.*)$"
    part = lambda pattern, i: F.regexp_extract(name, pattern, i)
    return F.array(F.when(name.rlike(single), F.concat(part(single, 1), F.lit(" "), part(single, 2))).when(name.rlike(three), F.concat(part(three, 1), F.lit("m"), part(three, 2))))


def neighbour_names(name: Column) -> Column:
    """The last number less and more by one."""
    shape = r"^(.+\D)(\d+)$"
    number = F.regexp_extract(name, shape, 2).try_cast("bigint")
    return F.array(*(F.when(number.isNotNull(), F.concat(F.regexp_extract(name, shape, 1), (number + k).cast("string"))) for k in (-1, 1)))


def range_names(name: Column) -> Column:
    """'FST 32-250/55-75': its first and its second end."""
    shape = r"(?i)^(.+/)([\d.]+)([A-Z]?)\s*[-]\s*([\d.]+)([A-Z]?)$"
    part = lambda i: F.regexp_extract(name, shape, i)
    return F.array(*(F.when(name.rlike(shape), F.concat(part(1), part(i), part(i + 1))) for i in (2, 4)))


def bare_names(name: Column) -> Column:
    """Without a known series before it; 'T/' as '(.)/'."""
    short = F.trim(F.regexp_replace(name, r"^(?:MATRIX|CDXM?|DWF?|DW\s*VOX)\s*", ""))
    return F.array(short, F.replace(short, F.lit("T/"), F.lit("(.)/")))


def frame_of(name: Column) -> Column:
    """Size and impeller, whatever the series: 'FST 65-200/75' is '65-200'; null without them."""
    found = F.regexp_extract(name, r"(?i)^(?:FST4?|FS4?|FSM|[A-Za-z]+)\s*(\d+\s*[-]\s*\d+)", 1)
    return F.when(found != "", F.replace(found, F.lit(" "), F.lit("")))


CHAIN = (
    Fill("sibling", 0.4, sibling_names, complete=False),
    Fill("phase_variant", 0.35, phase_names, complete=False),
    Fill("neighbor", 0.3, neighbour_names),
    Fill("range_split", 0.3, range_names),
    Fill("same_frame", 0.25, frame=frame_of, lacking="h"),
    Fill("prefix_dedup", 0.35, bare_names, values=("q", "h")),
)


def _complete(values=VALUES) -> Column:
    out = F.lit(True)
    for x in values:
        out = out & (F.coalesce(F.col(x), F.lit(0.0)) > 0)
    return out


def apply_fill(models: DataFrame, fill: Fill) -> DataFrame:
    """One pass over models (key, model, place, q, h, kw, and confidence_ and source_ of each): every taker sees the values
    as they were before the pass."""
    lacks = ~_complete() & ((F.coalesce(F.col(fill.lacking), F.lit(0.0)) <= 0) if fill.lacking else F.lit(True))
    donors = models.where(_complete()) if fill.complete else models
    given = [F.when(F.col(x) > 0, F.col(x)).alias(f"_{x}") for x in fill.values]
    takers = models.where(lacks)
    if fill.frame is not None:
        frame = fill.frame(F.col("model")).alias("_frame")
        first = donors.select(frame, "place", *given).where("_frame IS NOT NULL").groupBy("_frame").agg(*(F.min_by(f"_{x}", "place").alias(f"_{x}") for x in fill.values))
        best = takers.select("key", frame).join(first, "_frame").drop("_frame")
    else:
        asked = takers.select("key", F.posexplode(F.transform(fill.names(F.col("model")), lambda n: fill_key(n))).alias("_place", "_other")).where("_other IS NOT NULL")
        found = asked.join(donors.select(F.col("key").alias("_other"), *given), "_other")
        best = found.groupBy("key").agg(*(F.min_by(f"_{x}", F.when(F.col(f"_{x}").isNotNull(), F.col("_place"))).alias(f"_{x}") for x in fill.values))
    out = models.join(best, "key", "left")
    for x in fill.values:
        take = (F.coalesce(F.col(x), F.lit(0.0)) <= 0) & F.col(f"_{x}").isNotNull()
        out = out.withColumns({f"confidence_{x}": F.when(take, fill.confidence).otherwise(F.col(f"confidence_{x}")), f"source_{x}": F.when(take, fill.source).otherwise(F.col(f"source_{x}")), x: F.when(take, F.col(f"_{x}")).otherwise(F.col(x))})
    return out.select(*models.columns)


def fill_chain(models: DataFrame, chain: tuple[Fill, ...] = CHAIN) -> DataFrame:
    """models (model, place, q, h, kw and other columns) with the gaps filled, pass by pass, and with key, confidence_ and
    source_ of each value that a pass has filled (null for the others).

    A model is missing a value that is 0 or null. Every pass sees what the passes before it have filled: a model that one pass
    completes gives in the next one. One model is expected for each key; of several the first by place counts, the others are
    dropped, as are null and empty names. The table is staged between passes.
    """
    values = {f"{kind}_{x}": F.lit(None).cast(t) for x in VALUES for kind, t in (("confidence", "double"), ("source", "string"))}
    own = models.withColumn("key", fill_key(F.col("model"))).where("key <> ''")
    first = own.groupBy("key").agg(F.min("place").alias("place"))
    own = staged(own.join(first, ["key", "place"]).dropDuplicates(["key"]).withColumns(values), "fill-chain")
    for k, fill in enumerate(chain):
        own = apply_fill(own, fill)
        if k < len(chain) - 1:
            own = staged(own, "fill-chain")
    return own
