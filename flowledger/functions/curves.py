"""Q-H curves as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound
from .numbers import half_up


def has_curve(q: Column, h: Column) -> Column:
    return F.coalesce((F.size(q) >= 3) & (F.size(h) >= 3), F.lit(False))


def zip_truncate(q: Column, h: Column) -> Column:
    """array of struct(q, h), as long as the shorter one."""
    n = F.least(F.size(q), F.size(h))
    return F.arrays_zip(F.slice(q, 1, n).alias("q"), F.slice(h, 1, n).alias("h"))


def bep_point(q: Column, h: Column, share: float = 0.65) -> Column:
    """struct(q, h) of the point nearest to a share of the greatest flow, the first of two equally near."""
    aim = F.array_max(q) * share
    points = F.transform(zip_truncate(q, h), lambda x, i: F.struct(F.abs(x["q"] - aim).alias("apart"), i.alias("i"), x["q"].alias("q"), x["h"].alias("h")))
    best = F.array_min(points)
    return F.struct(best["q"].alias("q"), best["h"].alias("h"))


def interpolate(q: Column, h: Column, target: Column) -> Column:
    """Head at a flow on the first segment around it, rounded to 2 places; else the head of the nearest point."""
    inside = lambda i: target.between(F.least(F.get(q, i), F.get(q, i + 1)), F.greatest(F.get(q, i), F.get(q, i + 1)))
    at = F.try_element_at(F.filter(F.sequence(F.lit(0), F.size(q) - 2), inside), F.lit(1))
    run = F.get(q, at + 1) - F.get(q, at)
    on = F.when(F.abs(run) < 0.001, F.get(h, at)).otherwise(half_up(F.get(h, at) + (target - F.get(q, at)) / run * (F.get(h, at + 1) - F.get(h, at)), 2))
    near = F.array_min(F.transform(q, lambda x, i: F.struct(F.abs(x - target).alias("apart"), i.alias("i"))))["i"]
    return F.when(F.size(q) < 2, F.get(h, near)).otherwise(F.coalesce(F.when(at.isNotNull(), on), F.get(h, near)))


def _steps(x: Column, rising: bool) -> Column:
    pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: b > a if rising else b < a)
    return F.size(F.filter(pairs, lambda y: y))


def is_swapped(q: Column, h: Column) -> Column:
    """Flow falls and head rises in over 60 % of the steps: the arrays stand in each other's place."""
    n = F.size(q) - 1
    return F.coalesce((n >= 2) & (_steps(q, False) > n * 0.6) & (_steps(h, True) > n * 0.6), F.lit(False))


def fix_flow(q: Column) -> Column:
    """Repairs up to three places where flow doesn't rise: the neighbour that departs more from the mean of its own
    neighbours takes that mean. The repairs see each other, from left to right; without full success q stays as it is."""
    falls = lambda x: F.filter(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.get(x, i) <= F.get(x, i - 1))
    put = lambda a, at, value: F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))

    def step(state: Column, i: Column) -> Column:
        a, done = state["q"], state["done"]
        left = (F.get(a, i - 2) + F.get(a, i)) / 2
        right = (F.get(a, i - 1) + F.get(a, i + 1)) / 2
        far = F.lit(float("inf"))
        by_left = F.when(i >= 2, F.abs(F.get(a, i - 1) - left)).otherwise(far)
        by_right = F.when(i < F.size(a) - 1, F.abs(F.get(a, i) - right)).otherwise(far)
        use_left = (by_left >= by_right) & (i >= 2)
        at = F.when(use_left, i - 1).when(i < F.size(a) - 1, i)
        value = half_up(F.when(use_left, left).otherwise(right), 1)

        def repaired(x: Column) -> Column:
            skip = F.array_contains(done, i) | x["at"].isNull()
            return F.struct(F.when(skip, a).otherwise(put(a, x["at"], x["value"])).alias("q"), F.when(skip, done).otherwise(F.array_append(done, x["at"])).alias("done"))

        return bound(F.struct(at.alias("at"), value.alias("value")), repaired)

    def fixed(own: Column) -> Column:
        bad, start = own["bad"], F.struct(own["q"].alias("q"), F.array().cast("array<int>").alias("done"))
        whole = bound(F.aggregate(bad, start, step)["q"], lambda x: F.when(F.size(falls(x)) == 0, x))
        return F.when((F.size(own["q"]) >= 3) & F.size(bad).between(1, 3), F.coalesce(whole, own["q"])).otherwise(own["q"])

    return bound(F.struct(q.alias("q"), falls(q).alias("bad")), fixed)


def is_ascending(x: Column, share: float = 0.7) -> Column:
    """Three values or more, and steps that don't fall number at least a share of the values."""
    n = F.size(x)
    return F.coalesce((n >= 3) & (n - 1 - _steps(x, False) >= n * share), F.lit(False))


def as_text(x: Column) -> Column:
    return F.concat_ws(";", F.transform(x, lambda v: v.cast("string")))


def scale_round(x: Column, factor: float, places: int) -> Column:
    return F.transform(x, lambda v: half_up(v * factor, places))
