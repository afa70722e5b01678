"""Pump physics: efficiency, motor sizes, pump types, validity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import bound, once

# Water at 20 °C, gravity, IEC motor sizes in kW.
DENSITY, GRAVITY = 998.0, 9.81
IEC_KW = [
    0.06, 0.09, 0.12, 0.18, 0.25, 0.37, 0.55, 0.75, 1.1, 1.5, 2.2, 3.0, 4.0, 5.5, 7.5, 11.0, 15.0, 18.5, 22.0, 30.0, 37.0, 45.0, 55.0, 75.0,
    90.0, 110.0, 132.0, 160.0, 200.0, 250.0, 315.0, 355.0, 400.0, 500.0, 630.0, 800.0, 1000.0,
]
# Greatest flow, greatest head, lowest and highest efficiency of each pump type.
PUMP_TYPES = {
    "centrifugal_single": (5000.0, 200.0, 0.30, 0.92),
    "centrifugal_multi": (500.0, 2500.0, 0.40, 0.88),
    "submersible_bore": (500.0, 800.0, 0.35, 0.80),
    "submersible_drain": (2000.0, 50.0, 0.20, 0.75),
    "sewage": (3000.0, 60.0, 0.15, 0.70),
    "circulator": (50.0, 15.0, 0.05, 0.60),
    "industrial": (50000.0, 500.0, 0.50, 0.93),
}
DEFAULT_TYPE = "centrifugal_single"
# Words of names that tell the type, in this order.
TYPE_WORDS = {
    "submersible_drain": ["drain", "dw", "sewage", "грязев", "дренаж", "канализ", "фекал"],
    "circulator": ["circul", "циркул", "ups", "wilo-star", "alpha"],
    "submersible_bore": ["sp", "sq", "скважин", "bore", "submers", "погруж"],
    "centrifugal_multi": ["cr", "cdl", "cdm", "cdmf", "bm", "bmn", "pv", "multi", "многоступ"],
}


def hydraulic_kw(q: Column, h: Column) -> Column:
    return F.lit(DENSITY) * GRAVITY * (q / 3600.0) * h / 1000.0


def efficiency(q: Column, h: Column, p: Column) -> Column:
    """Null unless flow, head and power are all positive."""
    return F.when((q > 0) & (h > 0) & (p > 0), hydraulic_kw(q, h) / p)


def _search(sizes: list[float], fits) -> Column:
    """The first size but the last for which fits(i) holds, else the last: a binary search as nested conditions, so that
    Spark compares a row about log2(sizes) times. fits must stay true once it is."""
    if len(sizes) == 1:
        return F.lit(sizes[0])

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(sizes[low])
        middle = (low + high) // 2
        return F.when(fits(middle), part(low, middle)).otherwise(part(middle + 1, high))

    return part(0, len(sizes) - 1)


def nearest_size(p: Column, sizes: list[float] | None = None) -> Column:
    """The nearest motor size, the smaller of two equally near; null for null."""
    own = sorted(sizes or IEC_KW)
    return F.when(p.isNotNull(), _search(own, lambda i: p - own[i] <= F.lit(own[i + 1]) - p))


def snap_power(p: Column, sizes: list[float] | None = None, low: float = 0.85, high: float = 1.15, near: Column | None = None) -> Column:
    """The nearest size where the power lies between low and high times it, else the power as it is. near: a column that
    holds the nearest size already."""
    near = nearest_size(p, sizes) if near is None else near
    return F.when((p > 0) & (p / near).between(low, high), near).otherwise(p)


def estimate_power(q: Column, h: Column) -> Column:
    """Shaft power by a typical efficiency, rounded up to a motor size (the largest at most); 0 without flow or head."""
    shaft = hydraulic_kw(q, h) / F.when(q < 10, 0.55).when(q < 50, 0.65).otherwise(0.72)
    return F.when((q > 0) & (h > 0), _search(IEC_KW, lambda i: F.lit(IEC_KW[i]) >= shaft)).otherwise(0.0)


def _low_name(model: Column, series: Column | None) -> Column:
    return F.lower(F.concat(F.coalesce(model, F.lit("")), F.lit(" "), F.coalesce(series, F.lit("")) if series is not None else F.lit("")))


def _types(q: Column, h: Column, p: Column, name: Column, stages: Column | None) -> list[tuple[Column, str]]:
    """(condition, type) by a name in small letters: the first condition that holds tells the type, else it is DEFAULT_TYPE."""
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(name, F.lit(w)) for w in words))
    out = [(has(words), kind) for kind, words in TYPE_WORDS.items()]
    many = h > 200 if stages is None else (h > 200) | (stages > 5)
    return [*out, ((h < 15) & (q < 50) & (p < 0.5), "circulator"), (many, "centrifugal_multi")]


def _by_type(types: list[tuple[Column, str]], value) -> Column:
    out = F.when(types[0][0], value(types[0][1]))
    for condition, kind in types[1:]:
        out = out.when(condition, value(kind))
    return out.otherwise(value(DEFAULT_TYPE))


def pump_type(q: Column, h: Column, p: Column, model: Column, series: Column | None = None, stages: Column | None = None) -> Column:
    """By words of the name, else by flow, head, power and stages."""
    return _by_type(_types(q, h, p, _low_name(model, series), stages), lambda kind: kind)


#: What PUMP_TYPES says of a type, in its order.
_LIMITS = ("_q_max", "_h_max", "_eta_low", "_eta_high")


def _limits(kind: Column) -> dict[str, Column]:
    of = lambda i: _by_type([(kind == k, k) for k in PUMP_TYPES if k != DEFAULT_TYPE], lambda k: PUMP_TYPES[k][i])
    return {name: of(i) for i, name in enumerate(_LIMITS)}


def curve_penalty(q_points: Column, h_points: Column) -> Column:
    """-0.2 if flow doesn't rise in the working range (over a fifth of its maximum), -0.2 if head rises by over 5 % in
    more than 0.4 of its points; 0 for curves of fewer than three points."""
    start = F.array_max(q_points) * 0.2
    pairs = F.arrays_zip(q_points.alias("q"), h_points.alias("h"))
    work = F.transform(F.filter(pairs, lambda x: x["q"] > start), lambda x: x["h"])
    steps = F.sequence(F.lit(1), F.size(q_points) - 1)
    falls = F.exists(steps, lambda i: (F.get(q_points, i) > start) & (F.get(q_points, i) <= F.get(q_points, i - 1)))
    rises = F.size(F.filter(F.sequence(F.lit(1), F.size(work) - 1), lambda i: F.get(work, i) > F.get(work, i - 1) * 1.05))
    penalty = F.when(falls, -0.2).otherwise(0.0) + F.when((F.size(work) >= 3) & (rises > F.size(work) * 0.4), -0.2).otherwise(0.0)
    return F.when((F.size(q_points) >= 3) & (F.size(h_points) >= 3), penalty).otherwise(0.0)


def _reason(q: Column, h: Column, eta: Column, limits: dict[str, Column]) -> Column:
    return (
        F.when(F.coalesce(q, F.lit(0.0)) <= 0, "no_flow")
        .when(h < 0, "negative_head")
        .when(q > limits["_q_max"] * 2, "flow_too_large")
        .when(h > limits["_h_max"] * 2, "head_too_large")
        .when(eta > 0.96, "efficiency_impossible")
        .when(eta < 0.02, "efficiency_garbage")
        .otherwise("ok")
    )


def _adjustment(p: Column, kind: Column, eta: Column, limits: dict[str, Column], near: Column, curve: Column | None) -> Column:
    by_eta = F.when(eta < limits["_eta_low"] * 0.5, -0.25).when(eta > limits["_eta_high"], -0.15).otherwise(0.0)
    ratio = p / near
    by_motor = F.when((kind != "circulator") & (p > 0) & ((ratio < 0.75) | (ratio > 1.35)), -0.1).otherwise(0.0)
    return by_eta + by_motor if curve is None else by_eta + curve + by_motor


def with_checks(entries: DataFrame, q: str = "q_nom", h: str = "h_nom", p: str = "power_kw", model: str = "model", series: str | None = None, stages: str | None = None, curves: tuple[str, str] | None = None) -> DataFrame:
    """entries with kind (pump type), eta, near_kw (nearest motor size), reason ('ok' or a code) and adjustment (what
    confidence loses). Each is a column of its own, worked out once, since later ones use it many times; filters on them
    aren't worked into the search for the type."""
    q, h, p, model = F.col(q), F.col(h), F.col(p), F.col(model)
    low = bound(_low_name(model, F.col(series) if series else None), lambda name: _by_type(_types(q, h, p, name, F.col(stages) if stages else None), lambda kind: kind))
    out = once(entries, bound(low, lambda kind: F.struct(kind.alias("kind"), efficiency(q, h, p).alias("eta"), nearest_size(p).alias("near_kw"), *(x.alias(name) for name, x in _limits(kind).items()))), [x for x in entries.columns if x not in ("kind", "eta", "near_kw", *_LIMITS)])
    limits, eta = {x: F.col(x) for x in _LIMITS}, F.col("eta")
    loss = _adjustment(p, F.col("kind"), eta, limits, F.col("near_kw"), curve_penalty(*map(F.col, curves)) if curves else None)
    usual = F.coalesce(eta.between(F.col("_eta_low"), F.col("_eta_high")), F.lit(False))
    out = out.withColumns({"reason": _reason(q, h, eta, limits), "_loss": loss, "usual_eta": usual})
    return out.withColumn("adjustment", F.when(F.col("reason") == "ok", F.col("_loss")).otherwise(0.0)).drop(*_LIMITS, "_loss")


#: What with_checks adds.
CHECKS = ("kind", "eta", "near_kw", "reason", "adjustment", "usual_eta")


def validate(q: Column, h: Column, p: Column, model: Column, series: Column | None = None, stages: Column | None = None, q_points: Column | None = None, h_points: Column | None = None) -> Column:
    """struct(ok, reason, adjustment) as one expression, for single uses; with_checks is the form for tables."""
    kind, eta = pump_type(q, h, p, model, series, stages), efficiency(q, h, p)
    limits = _limits(kind)
    reason = _reason(q, h, eta, limits)
    total = _adjustment(p, kind, eta, limits, nearest_size(p), curve_penalty(q_points, h_points) if q_points is not None else None)
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"), F.when(reason == "ok", total).otherwise(0.0).alias("adjustment"))


def normalise_rpm(rpm: Column) -> Column:
    """Slip speeds to 2900, 1450 and 960."""
    return F.when(rpm.between(2850, 2970), 2900).when(rpm.between(1440, 1500), 1450).when(rpm.between(950, 990), 960).otherwise(rpm)


def basic_reason(model: Column, q: Column, h: Column, p: Column) -> Column:
    """'ok', or why an entry can't be one."""
    return (
        F.when(F.coalesce(F.length(model), F.lit(0)) < 2, "empty_model")
        .when((q < 0) | (h < 0), "negative")
        .when((q > 100000) | (h > 5000), "unrealistic")
        .when((p < 0) | (p > 20000), "bad_power")
        .when((q == 0) & (h == 0), "no_point")
        .otherwise("ok")
    )
