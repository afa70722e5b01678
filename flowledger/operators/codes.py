"""Coded model names decoded by rule tables: what a family's code states, and look-ups of flow, head and stages in joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.modelcodes import speed_of_poles
from ..functions.numbers import half_up

# Flow of a nominal width by family.
FLOW_OF_WIDTH = {
    "MBL": {32: 6.3, 40: 12.5, 50: 25, 65: 50, 80: 50, 100: 100, 125: 160, 150: 200, 200: 400},
    "TG": {25: 6, 32: 12.5, 40: 20, 50: 30, 65: 50, 80: 80, 100: 120, 125: 180, 150: 250, 200: 400, 300: 900},
    "FST": {25: 3, 32: 6.3, 40: 12.5, 50: 25, 65: 50, 80: 50, 100: 100, 125: 160, 150: 200},
}
# Head by flow and stages.
HEAD_OF_POINT = {
    "FVH": {
        (1, 2): 17, (1, 3): 25, (1, 4): 33, (1, 5): 40, (1, 6): 48, (2, 2): 25, (2, 3): 36, (2, 4): 50, (2, 5): 61, (2, 6): 71, (4, 2): 26, (4, 3): 40, (4, 4): 53, (4, 5): 66, (4, 6): 80,
        (6, 3): 45, (6, 4): 59, (6, 5): 75, (6, 6): 89, (8, 2): 20, (8, 3): 30, (8, 4): 40, (8, 5): 50, (12, 2): 22, (12, 3): 36, (12, 4): 51,
    },
    "FV": {
        (4, 7): 53, (4, 9): 68, (4, 13): 98, (4, 16): 121, (6, 5): 36, (6, 8): 58, (6, 11): 80, (6, 15): 109, (8, 4): 30, (8, 7): 53, (8, 9): 68, (8, 12): 90, (8, 16): 121,
        (12, 3): 24, (12, 5): 42, (12, 7): 59, (12, 9): 76, (12, 12): 100, (12, 17): 145, (30, 7): 85, (30, 9): 109, (30, 11): 134,
    },
}
# Head of a stage by flow; of the last family by series number, with 5 for others.
HEAD_OF_STAGE = {
    "FV": {4: 7.8, 6: 7.4, 8: 7.7, 12: 8.6, 30: 12.2},
    "FVH": {1: 8.2, 2: 12.2, 4: 13.2, 6: 14.9, 8: 10.0, 12: 11.9},
    "CDM": {1: 18.0, 2: 13.0, 3: 9.5, 4: 8.6, 5: 7.0, 10: 10.0, 16: 8.7, 20: 7.5, 32: 8.0, 42: 7.5, 65: 7.0, 85: 6.5, 120: 5.5, 150: 5.0, 155: 5.0, 185: 4.5, 200: 4.0, 215: 3.8, 250: 3.5},
    "CV": {1: 25.0, 2: 15.0, 3: 12.0, 4: 10.0, 5: 8.0, 10: 5.8, 15: 4.5, 20: 4.0, 32: 3.2, 45: 2.8, 64: 2.5, 90: 2.2, 120: 2.0, 150: 1.8, 200: 1.5, 320: 1.2},
    "BM": {1: 8.0, 3: 8.0, 5: 7.5, 10: 7.0, 15: 11.5, 20: 12.0, 32: 12.5, 45: 18.0, 64: 19.0, 95: 17.0, 125: 20.5, 155: 22.0, 185: 30.0, 215: 33.0, 255: 35.0},
}
# Head at 2900 rpm of impeller types; those that end in .1 or .2 have the head of the type without.
HEAD_OF_IMPELLER = {
    "32-125": 12.5, "32-160": 20.0, "32-200": 32.0, "32-250": 50.0, "40-125": 12.5, "40-160": 20.0, "40-200": 32.0, "40-250": 50.0, "40-315": 80.0, "50-125": 12.5, "50-160": 20.0, "50-200": 32.0, "50-250": 50.0, "50-315": 80.0,
    "65-125": 12.5, "65-160": 20.0, "65-200": 32.0, "65-250": 50.0, "65-315": 80.0, "80-160": 20.0, "80-200": 32.0, "80-250": 50.0, "80-315": 80.0, "80-400": 125.0, "100-160": 20.0, "100-200": 32.0, "100-250": 50.0, "100-315": 80.0,
    "100-400": 125.0, "125-200": 32.0, "125-250": 50.0, "125-315": 80.0, "125-400": 125.0, "125-500": 150.0, "150-200": 32.0, "150-250": 50.0, "150-315": 80.0, "150-400": 125.0, "150-500": 150.0,
    "200-250": 12.5, "200-315": 20.0, "250-315": 20.0, "300-315": 20.0, "350-400": 32.0,
}
# The shapes of the codes, in the order in which they are tried.
CODES = {
    "INL": r"(?iu)^INL\s*(\d+)\s*-\s*([\d.]+)\s*-\s*([\d.]+)\s*-\s*([\d.]+)\s*/\s*(\d+)",
    "MBL": r"(?iu)^[МM][ВB]L\s*(\d+)\s*-\s*([\d.]+)[A-Za-zА-Яа-я]*(?:\s*-\s*([\d.]+)\s*(?:/\s*(\d+))?)?",
    "FVH": r"(?iu)^FVH\s*(\d+)[x×](\d+)/?([\d.]*)",
    "FV": r"(?iu)^FV\s*(\d+)[x×](\d+)/?([\d.]*)",
    "TG": r"(?iu)^(?:TL|TG|TD)\s*(\d+)\s*-\s*([\d.]+)",
    "FST": r"(?iu)^(?:FST4|FST|FS4|FSM|FS)\s*(\d+)\s*-\s*(\d+)(?:\s*/\s*([\d.]+))?",
    "PV": r"(?iu)^PV\s*\(?n?\)?\s*(\d+)\s*-\s*(\d+)",
    "CDM": r"(?iu)^(?:CDM|CDMF|CDL|CDLF)\s*F?\s*(\d+)\s*-\s*(\d+)",
    "CV": r"(?iu)^CVF?\s*(\d+)\s*-\s*(\d+)(?:\s*/\s*([\d.]+))?",
    "EVR": r"(?iu)^(?:(?:EVR|EVS)\(?S?\)?\s*)?(\d+)\s*-+\s*(\d+)",
}
GENERIC = r"^[A-ZА-Яa-zа-я]+\s*([\d.]+)\s*-\s*([\d.]+)\s*-\s*([\d.]+)\s*(?:/\s*(\d+))?"
#: Heads of a stage by flow, up to and with each bound, of names without a table of their own.
STAGE_BANDS = ((5.0, 8.5), (20.0, 7.0), (64.0, 5.5), (math.inf, 4.0))
#: Share of the shut-off head at the nominal point.
SHUT_OFF_SHARE = 0.78


def rule_table(spark: SparkSession, values: dict[str, dict], columns: str) -> DataFrame:
    """One of the tables above as rows (family, key or keys, value)."""
    return F.broadcast(spark.createDataFrame([(family, *(k if isinstance(k, tuple) else (k,)), float(v)) for family, own in values.items() for k, v in own.items()], columns))


def _known(x: Column) -> Column:
    return F.when(x != 0, x)


def decode(entries: DataFrame, model: str = "model") -> DataFrame:
    """entries (model, q, h, p, rpm and others) with q, h, p and rpm filled from the code of the name, and family (null without
    one).

    Commas are dots, zero-width characters go, other dashes are dashes. INL states all four and MBL flow, head and, where it has
    them, power and speed: both override what was there. The other codes fill what is missing (0 or null): FV and FVH flow,
    power and the head of (flow, stages), else head of a stage times stages; TG flow of the width and a head up to 200; FST flow
    of the width and power (over 30 in tenths) up to 200; PV, CDM and CV flow, CV power, CDM and CV head of a stage times
    stages; EVR, and names that are numbers, a flow up to 200. An unknown width is half of itself. What still lacks flow or
    power and has three numbers between dashes takes the least one under 50 as power, and its speed from the poles. Names of no
    family, and null ones, stay as they are.

    The look-ups are tables of some dozen rows, joined on (family, flow, stages).
    """
    spark = entries.sparkSession
    s = F.regexp_replace(F.translate(F.trim(F.col(model)), ",–—‒", ".---"), "[​‌﻿]", "")
    own = entries.withColumn("_s", s)
    kind = F.coalesce(*(F.when(F.col("_s").rlike(code), family) for family, code in CODES.items()))
    own = own.withColumn("family", kind)

    def part(i: int) -> Column:
        return F.coalesce(*(F.when(F.col("family") == family, F.regexp_extract("_s", code, i)) for family, code in CODES.items() if code.replace(r"\(", "").count("(") - code.count("(?") >= i))

    own = own.withColumns({"_a": part(1).try_cast("int"), "_b": part(2), "_c": part(3).try_cast("double"), "_d": part(4), "_e": part(5).try_cast("int")})
    own = own.withColumn("_stages", F.col("_b").try_cast("int"))
    widths = rule_table(spark, FLOW_OF_WIDTH, "family string, _a int, _flow double")
    points = rule_table(spark, HEAD_OF_POINT, "family string, _a int, _stages int, _point double")
    stages = rule_table(spark, HEAD_OF_STAGE, "family string, _a int, _stage double")
    own = own.join(widths, ["family", "_a"], "left").join(points, ["family", "_a", "_stages"], "left").join(stages, ["family", "_a"], "left")

    is_ = lambda *families: F.coalesce(F.col("family").isin(*families), F.lit(False))
    a, b, c = F.col("_a").cast("double"), F.col("_b").try_cast("double"), F.col("_c")
    d, e = F.col("_d").try_cast("double"), F.col("_e")
    q, h, p, rpm = (F.col(x) for x in ("q", "h", "p", "rpm"))
    tip = math.pi * (b / 1000) * F.coalesce(_known(rpm), F.lit(2900)) / 60
    total = F.col("_stage") * F.col("_stages")
    flow = F.coalesce("_flow", a * 0.5)
    rated = F.when(c > 30, c / 10).otherwise(c)
    new_q = F.when(is_("FV", "FVH", "PV", "CDM", "CV"), a).when(is_("TG", "FST"), flow).when(is_("EVR") & (a <= 200), a)
    new_h = F.when(is_("FV", "FVH"), F.coalesce("_point", half_up(total, 0))).when(is_("TG") & (b <= 200), b).when(is_("CDM", "CV"), half_up(total, 1))
    new_p = F.when(is_("FV", "FVH", "CV"), c).when(is_("FST") & (rated <= 200), rated)
    own = own.withColumns({
        "q": F.when(is_("INL"), b).when(is_("MBL"), flow).otherwise(F.coalesce(_known(q), new_q, q)),
        "h": F.when(is_("INL"), c).when(is_("MBL"), half_up(tip * tip / 9.81 * 0.55, 1)).otherwise(F.coalesce(_known(h), new_h, h)),
        "p": F.when(is_("INL"), d).when(is_("MBL"), F.coalesce(c, p)).otherwise(F.coalesce(_known(p), new_p, p)),
        "rpm": F.when(is_("INL"), speed_of_poles(e)).when(is_("MBL") & (F.col("_d") != ""), speed_of_poles(F.col("_d").try_cast("int"))).otherwise(rpm),
    })
    numbers = [F.regexp_extract("_s", GENERIC, i).try_cast("double") for i in (1, 2, 3)]
    poles = F.regexp_extract("_s", GENERIC, 4).try_cast("int")
    rest = ~is_("INL", "MBL", "FV", "FVH") & F.col("_s").rlike(GENERIC) & ~((F.coalesce("q", F.lit(0.0)) != 0) & (F.coalesce("p", F.lit(0.0)) != 0))
    least = F.when(numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull(), F.least(*numbers))
    own = own.withColumns({"p": F.when(rest & (F.coalesce("p", F.lit(0.0)) == 0) & (least < 50), least).otherwise(F.col("p")), "rpm": F.when(rest & poles.isNotNull(), speed_of_poles(poles)).otherwise(F.col("rpm"))})
    return own.select(*entries.columns, "family")


def impeller_heads(rows: DataFrame, kind: str, rpm: str) -> DataFrame:
    """rows with h: the head of an impeller type such as '32-125.1' at a speed: of the type, else of the type without its last
    part, else by the affinity laws from its width, else 20; a quarter at 1450 rpm. A null type has 20 too."""
    table = rule_table(rows.sparkSession, {"": HEAD_OF_IMPELLER}, "_family string, _type string, _head double").drop("_family")
    own = rows.withColumns({"_type": F.regexp_replace(F.coalesce(kind, F.lit("")), r"\.\d+$", ""), "_wide": F.regexp_extract(F.col(kind), r"-(\d{3,4})(?:\.\d)?$", 1).try_cast("double")})
    by_width = half_up((F.col("_wide") / 200) * (F.col("_wide") / 200) * 32.0, 1)
    full = F.coalesce("_head", by_width, F.lit(20.0))
    own = own.join(F.broadcast(table), "_type", "left")
    return own.withColumn("h", F.when(F.col(rpm) == 1450, half_up(full * 0.25, 1)).otherwise(full)).select(*rows.columns, "h")


def stage_heads(rows: DataFrame, family: str, number: str, stages: str, default: float = 5.0) -> DataFrame:
    """rows with h: stages times the head of a stage of the family's series number (default for others), to a tenth."""
    table = rule_table(rows.sparkSession, {family: HEAD_OF_STAGE[family]}, "_family string, _a int, _stage double").drop("_family")
    own = rows.join(F.broadcast(table), F.col(number).cast("int") == F.col("_a"), "left")
    return own.withColumn("h", half_up(F.col(stages) * F.coalesce("_stage", F.lit(default)), 1)).select(*rows.columns, "h")


def banded_head(flow: Column, stages: Column, bands: tuple[tuple[float, float], ...] = STAGE_BANDS) -> Column:
    """Stages times the head of a stage of the first band that the flow is within, to a tenth."""
    per_stage = F.coalesce(*(F.when(flow <= most, head) for most, head in bands))
    return half_up(stages * per_stage, 1)


def shut_off_head(name: Column, share: float = SHUT_OFF_SHARE) -> Column:
    """'VO32-120': a share of the shut-off head, which the last number states in tenths of a metre (1 to 9999); 0 without."""
    code = F.try_element_at(F.split(name, "-"), F.lit(-1)).try_cast("int")
    return F.when(name.contains("-") & code.between(1, 9999), half_up(code / 10.0 * share, 1)).otherwise(0.0)
