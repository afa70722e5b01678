"""Repair, confidence, outliers and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.names import series_of
from ..functions.numbers import half_up
from ..functions.units import PER_MINUTE
from ..sources.staging import staged


def self_heal(entries: DataFrame) -> DataFrame:
    """Repairs in order, each seeing the one before: flow taken for l/min, head taken for bar, missing power estimated,
    power snapped to a motor size. fixes lists what was done. (Swapping flow and head can't change the efficiency, which
    is symmetric in them, so that repair never applies.)"""
    q, h, p = F.col("q_nom"), F.col("h_nom"), F.col("power_kw")
    some = (q > 0) | (h > 0)
    out = entries.withColumns({"_eta": physics.efficiency(q, h, p), "_eta_q": physics.efficiency(q * PER_MINUTE, h, p), "_eta_h": physics.efficiency(q, h * 10.2, p)})
    sound = lambda x: F.coalesce(x.between(0.10, 0.96), F.lit(False))
    odd = some & (q > 0) & (p > 0) & ~sound(F.col("_eta"))
    by_flow = odd & (q > 30) & (h > 0) & sound(F.col("_eta_q"))
    by_head = odd & ~by_flow & (h > 0) & (h < 10) & sound(F.col("_eta_h"))
    out = out.withColumns({"_flow": by_flow, "_head": by_head})
    out = out.withColumns({"q_nom": F.when(F.col("_flow"), half_up(q * PER_MINUTE, 2)).otherwise(q), "h_nom": F.when(F.col("_head"), half_up(h * 10.2, 1)).otherwise(h)})
    out = out.withColumn("_power", (p <= 0) & (q > 0) & (h > 0)).withColumn("power_kw", F.when(F.col("_power"), physics.estimate_power(q, h)).otherwise(p))
    out = out.withColumn("_near", physics.nearest_size(p))
    out = out.withColumn("_snapped", F.when(some, physics.snap_power(p, near=F.col("_near"))).otherwise(p)).withColumn("_snap", F.col("_snapped") != p).withColumn("power_kw", F.col("_snapped"))
    names = {"_flow": "flow_per_minute", "_head": "head_in_bar", "_power": "power_estimated", "_snap": "power_snapped"}
    fixes = F.array_compact(F.array(*(F.when(F.col(c), name) for c, name in names.items())))
    return out.withColumn("fixes", fixes).drop(*names, "_snapped", "_near", "_eta", "_eta_q", "_eta_h")


def completeness_share(has_curve: Column | None = None, extra: dict[str, float] | None = None) -> Column:
    """Known fields' points as a share of all 14: flow 3, head 3, power 2, curve 3, speed 1, and others' own points."""
    points = [F.when(F.col(x) > 0, w).otherwise(0.0) for x, w in {"q_nom": 3.0, "h_nom": 3.0, "power_kw": 2.0, "rpm": 1.0}.items()]
    if has_curve is not None:
        points.append(F.when(has_curve, 3.0).otherwise(0.0))
    points += [F.when(F.col(x) > 0, w).otherwise(0.0) for x, w in (extra or {}).items()]
    return sum(points[1:], points[0]) / 14.0


def grounding(model: Column, text: Column) -> Column:
    """1 if the text has the model's name, 0.9 without blanks, 0.2 if not, 0.3 without a name, 0.5 without a text."""
    name, body = F.upper(F.trim(model)), F.upper(text)
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.5).when(name == "", 0.3).when(F.contains(body, name), 1.0).when(F.contains(bare(body), bare(name)), 0.9).otherwise(0.2)


def calibrate(entries: DataFrame, text: Column | None = None, healed: Column | None = None) -> DataFrame:
    """confidence from completeness .25, physics .30, grounding .20, motor size .10 and the former confidence .15; times
    .90 when repaired; between .05 and .99, to three places. Adds reason, what with_checks finds; a column of that name goes."""
    q, p, model = F.col("q_nom"), F.col("power_kw"), F.col("model")
    out = physics.with_checks(entries)
    reward = F.lit(0.8) + F.col("adjustment") + F.when(F.col("usual_eta"), 0.2).otherwise(0.0)
    out = out.withColumn("_ratio", p / F.col("near_kw")).withColumn("_reward", F.greatest(F.lit(0.0), F.least(F.lit(1.0), reward)))
    by_physics = F.when(q <= 0, 0.2).when(F.col("reason") != "ok", 0.1).otherwise(F.col("_reward"))
    ratio = F.col("_ratio")
    by_motor = F.when(p <= 0, 0.5).when(p == F.col("near_kw"), 1.0).when(ratio.between(0.95, 1.05), 0.9).when(ratio.between(0.85, 1.15), 0.7).when(ratio.between(0.75, 1.35), 0.5).otherwise(0.2)
    ground = grounding(model, text) if text is not None else F.lit(0.5)
    total = completeness_share() * 0.25 + by_physics * 0.30 + ground * 0.20 + by_motor * 0.10 + F.least("confidence", F.lit(1.0)) * 0.15
    if healed is not None:
        total = total * F.when(healed, 0.90).otherwise(1.0)
    return out.withColumn("confidence", half_up(F.greatest(F.lit(0.05), F.least(F.lit(0.99), total)), 3)).drop("_ratio", "_reward", *(x for x in physics.CHECKS if x != "reason"))


#: Ranges that a search for a place splits a range into.
RANGES = 4096


def nearest_rank(values: DataFrame, group: str | list[str], value: str, percents: list[int], least: int = 5) -> DataFrame:
    """group, n, p<percent>..: the value at place floor(n * percent / 100) of the sorted values of each group that has least
    values or more; null values don't count.

    Exact selection without a sort of any group: equal values are counted first; then the span of a group is cut into RANGES
    ranges, their counts are summed up in order, and only the range that holds the place is cut again, until it is one value.
    A group's values stay spread over all tasks; what meets in one is RANGES rows for each group and percent.
    """
    group = [group] if isinstance(group, str) else list(group)
    counts = staged(values.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")), "value-counts")
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where(F.col("n") >= least)
    at = F.least(F.floor(F.col("n") * F.col("_p") / 100), F.col("n") - 1)
    targets = staged(totals.withColumn("_p", F.explode(F.array(*map(F.lit, percents)))).withColumn("_at", at), "places")
    while not (open_ := targets.where("_low < _high")).isEmpty():
        share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        own = counts.join(open_, group).where("_v >= _low AND _v <= _high").withColumn("_range", F.floor(share * RANGES))
        ranges = own.groupBy(*group, "_p", "n", "_at", "_range").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_c").over(Window.partitionBy(*group, "_p").orderBy("_range"))
        holds = ranges.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at")))
        holds = holds.withColumn("_at", F.col("_at") - (F.col("_upto") - F.col("_c"))).select(*targets.columns)
        targets = staged(targets.where("_low >= _high").unionByName(holds), "places")
    return targets.groupBy(*group, "n").agg(*(F.max(F.when(F.col("_p") == p, F.col("_low"))).alias(f"p{p}") for p in percents))


def _series(entries: DataFrame) -> DataFrame:
    return entries.withColumn("series_key", F.when(series_of(F.col("model")) == "", "OTHER").otherwise(series_of(F.col("model"))))


def iqr_outliers(entries: DataFrame, columns: tuple[str, ...] = ("q_nom", "h_nom", "power_kw"), fence: float = 3.0) -> DataFrame:
    """<column>_outlier: outside fence quartile ranges of the positive values of its series (five of them at least), and
    outlier_factor: 0.85 for each."""
    out = _series(entries)
    long = out.select("series_key", F.explode(F.create_map(*(y for x in columns for y in (F.lit(x), F.col(x).cast("double"))))).alias("column", "value"))
    limits = nearest_rank(long.where("value > 0"), ["series_key", "column"], "value", [25, 75]).where("p75 > p25")
    span = fence * (F.col("p75") - F.col("p25"))
    of = lambda x, v: F.max(F.when(F.col("column") == x, v))
    wide = limits.groupBy("series_key").agg(*(c for x in columns for c in (of(x, F.col("p25") - span).alias(f"_low_{x}"), of(x, F.col("p75") + span).alias(f"_high_{x}"))))
    out = out.join(wide, "series_key", "left")
    odd = {f"{x}_outlier": F.coalesce((F.col(x) > 0) & ((F.col(x) < F.col(f"_low_{x}")) | (F.col(x) > F.col(f"_high_{x}"))), F.lit(False)) for x in columns}
    out = out.withColumns(odd).drop(*(f"_{end}_{x}" for end in ("low", "high") for x in columns))
    factor = F.lit(1.0)
    for x in odd:
        factor = factor * F.when(F.col(x), 0.85).otherwise(1.0)
    return out.withColumn("outlier_factor", factor)


def eta_anomalies(entries: DataFrame, high: float = 3.0, low: float = 0.33) -> DataFrame:
    """eta, median_eta of the series (over values between .01 and 2, five at least) and eta_anomaly: over high or under
    low times the median."""
    out = _series(entries).withColumn("eta", physics.efficiency(F.col("q_nom"), F.col("h_nom"), F.col("power_kw")))
    some = out.where("eta is not null")
    medians = nearest_rank(some.where((F.col("eta") > 0.01) & (F.col("eta") < 2.0)), "series_key", "eta", [50]).select("series_key", F.col("p50").alias("median_eta"))
    ratio = F.col("eta") / F.col("median_eta")
    return out.join(medians, "series_key", "left").withColumn("eta_anomaly", F.coalesce((ratio > high) | (ratio < low), F.lit(False)))


def same_point(entries: DataFrame, order: tuple[str, ...] = ("seq", "q_nom", "h_nom", "confidence")) -> DataFrame:
    """same_as: the model of the first record with the same flow, head and power (to one place), if its name differs."""
    keys = {f"_{x}": half_up(F.col(x), 1) for x in ("q_nom", "h_nom", "power_kw")}
    some = entries.withColumns(keys)
    real = (F.col("q_nom") > 0) | (F.col("h_nom") > 0)
    first = some.where(real).groupBy(*keys).agg(F.min(F.struct(*order, F.col("model").alias("first_model")))["first_model"].alias("first_model"))
    joined = some.join(first, list(keys), "left")
    return joined.withColumn("same_as", F.when(real & (F.upper("first_model") != F.upper("model")), F.col("first_model"))).drop(*keys, "first_model")


GATES = ("min_models", "avg_confidence", "physics_rate", "low_conf_ratio", "consistency")


def quality_gates(entries: DataFrame, catalog: str = "source_file", pages: str = "source_page", processed: DataFrame | None = None) -> DataFrame:
    """A row for each catalogue and gate: gate, value, verdict (pass, warn or fail), and overall, the worst of the five.

    Two models are expected for ten pages: of processed (catalogue, page: all pages that were read, also those without records),
    else of the pages that gave records. A catalogue that is in processed only has no records and fails.
    """
    entries = physics.with_checks(entries)
    positive = lambda x: F.when(F.col(x) > 0, F.col(x))
    spans = {x: F.when(F.count(positive(x)) >= 3, F.max(positive(x)) / F.min(positive(x))) for x in ("q_nom", "h_nom", "power_kw")}
    stats = entries.groupBy(catalog).agg(
        F.count("*").alias("n"),
        F.countDistinct(pages).alias("n_pages"),
        F.avg("confidence").alias("mean"),
        F.avg((F.col("reason") == "ok").cast("double")).alias("rate"),
        F.avg((F.col("confidence") < 0.4).cast("double")).alias("low"),
        *(c.alias(f"span_{x}") for x, c in spans.items()),
    )
    if processed is not None:
        read = processed.groupBy(catalog).agg(F.countDistinct(pages).alias("_read"))
        stats = stats.join(read, catalog, "full").withColumns({"n_pages": F.coalesce("_read", "n_pages"), **{x: F.coalesce(x, F.lit(0)) for x in ("n", "mean", "rate")}, "low": F.coalesce("low", F.lit(1.0))}).drop("_read")
    expected = F.greatest(F.lit(1.0), F.col("n_pages") / 10 * 2)
    wide = sum((F.coalesce(F.col(f"span_{x}") > 1000, F.lit(False)).cast("int") for x in spans), F.lit(0))
    verdict = lambda good, fair: F.when(good, "pass").when(fair, "warn").otherwise("fail")
    gate = lambda name, value, v: F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), v.alias("verdict"))
    gates = F.array(
        gate("min_models", F.col("n"), verdict(F.col("n") >= expected, F.col("n") >= expected * 0.5)),
        gate("avg_confidence", half_up(F.col("mean"), 6), verdict(half_up(F.col("mean"), 9) >= 0.6, half_up(F.col("mean"), 9) >= 0.4)),
        gate("physics_rate", half_up(F.col("rate"), 6), verdict(F.col("rate") >= 0.8, F.col("rate") >= 0.5)),
        gate("low_conf_ratio", half_up(F.col("low"), 6), verdict(F.col("low") <= 0.3, F.col("low") <= 0.5)),
        gate("consistency", wide, F.when((F.col("n") >= 3) & (wide > 0), "warn").otherwise("pass")),
    )
    worst = F.when(F.exists(gates, lambda g: g["verdict"] == "fail"), "fail").when(F.exists(gates, lambda g: g["verdict"] == "warn"), "warn").otherwise("pass")
    return stats.select(catalog, worst.alias("overall"), F.inline(gates))


def extraction_score(entries: DataFrame, by: list[str], grounded: Column | None = None, curves: Column | None = None) -> DataFrame:
    """0.5 for each record (50 at most), 30 times the complete share, 30 times the valid share, 20 times the grounded share,
    2 for each curve (15 at most); to one place."""
    q, h, p = F.col("q_nom"), F.col("h_nom"), F.col("power_kw")
    share = lambda c: F.avg(c.cast("double"))
    score = F.least(F.count("*"), F.lit(50)) * 0.5 + share((q > 0) & (h > 0) & (p > 0)) * 30 + share(F.col("reason") == "ok") * 30
    if grounded is not None:
        score = score + share(grounded) * 20
    if curves is not None:
        score = score + F.least(F.sum(curves.cast("int")) * 2, F.lit(15))
    return physics.with_checks(entries).groupBy(*by).agg(F.count("*").alias("n"), half_up(score, 1).alias("score"))
