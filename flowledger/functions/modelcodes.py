"""What coded model names tell: flow, head, power and speed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up

# Flow of a nominal width, and head of a stage by flow, for each coded family.
FLOW_OF_WIDTH = {
    "TG": {25: 6, 32: 12.5, 40: 20, 50: 30, 65: 50, 80: 80, 100: 120, 125: 180, 150: 250, 200: 400, 300: 900},
    "FST": {25: 3, 32: 6.3, 40: 12.5, 50: 25, 65: 50, 80: 50, 100: 100, 125: 160, 150: 200},
}
HEAD_OF_STAGE = {
    "CDM": {1: 18.0, 2: 13.0, 3: 9.5, 4: 8.6, 5: 7.0, 10: 10.0, 16: 8.7, 20: 7.5, 32: 8.0, 42: 7.5, 65: 7.0, 85: 6.5, 120: 5.5, 150: 5.0, 155: 5.0, 185: 4.5, 200: 4.0, 215: 3.8, 250: 3.5},
    "CV": {1: 25.0, 2: 15.0, 3: 12.0, 4: 10.0, 5: 8.0, 10: 5.8, 15: 4.5, 20: 4.0, 32: 3.2, 45: 2.8, 64: 2.5, 90: 2.2, 120: 2.0, 150: 1.8, 200: 1.5, 320: 1.2},
}
# The shapes of the codes.
CODES = {
    "INL": r"(?i)^INL\s*(\d+)\s*-\s*([\d.]+)\s*-\s*([\d.]+)\s*-\s*([\d.]+)\s*/\s*(\d+)",
    "TG": r"(?i)^(?:TL|TG|TD)\s*(\d+)\s*-\s*([\d.]+)",
    "FST": r"(?i)^(?:FST4|FST|FS4|FSM|FS)\s*(\d+)\s*-\s*(\d+)(?:\s*/\s*([\d.]+))?",
    "PV": r"(?i)^PV\s*\(?n?\)?\s*(\d+)\s*-\s*(\d+)",
    "CDM": r"(?i)^(?:CDM|CDMF|CDL|CDLF)\s*F?\s*(\d+)\s*-\s*(\d+)",
    "CV": r"(?i)^CVF?\s*(\d+)\s*-\s*(\d+)(?:\s*/\s*([\d.]+))?",
}


def _lookup(key: Column, values: dict[int, float]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, float(v)) if out is None else out.when(key == k, float(v))
    return out


def _missing(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0)) == 0


def affinity_head(impeller_mm: Column, rpm: Column, reference_mm: float = 200.0, reference_head: float = 32.0) -> Column:
    """Head of an impeller by the affinity laws, to a tenth: it grows with the square of its width and is a quarter at 1450 rpm."""
    full = half_up((impeller_mm / reference_mm) * (impeller_mm / reference_mm) * reference_head, 1)
    return F.when(rpm == 1450, half_up(full * 0.25, 1)).otherwise(full)


def speed_of_poles(poles: Column) -> Column:
    return F.when(poles >= 2, F.floor(F.lit(3000) / F.floor(poles / 2))).otherwise(2900).cast("int")


def from_model_name(name: Column, q: Column, h: Column, p: Column, rpm: Column) -> Column:
    """struct(q, h, p, rpm): what is missing (0 or null), derived from the family's code. The code of INL states all four and
    overrides what was there. Names of other families leave all as it is; null names too."""
    s = F.translate(F.replace(name, F.lit(","), F.lit(".")), "–—‒", "---")
    part = lambda family, i: F.regexp_extract(s, CODES[family], i)
    number = lambda family, i: part(family, i).try_cast("double")
    whole = lambda family, i: part(family, i).try_cast("int")
    fits = {family: F.coalesce(s.rlike(code), F.lit(False)) for family, code in CODES.items()}
    stage = lambda family: half_up(_lookup(whole(family, 1), HEAD_OF_STAGE[family]) * whole(family, 2), 1)
    width = lambda family: F.coalesce(_lookup(whole(family, 1), FLOW_OF_WIDTH[family]), number(family, 1) * 0.5)
    rated = F.when(number("FST", 3) > 30, number("FST", 3) / 10).otherwise(number("FST", 3))
    flow = F.when(fits["TG"], width("TG")).when(fits["FST"], width("FST")).when(fits["PV"], number("PV", 1)).when(fits["CDM"], number("CDM", 1)).when(fits["CV"], number("CV", 1))
    head = F.when(fits["TG"] & (number("TG", 2) <= 200), number("TG", 2)).when(fits["CDM"], stage("CDM")).when(fits["CV"], stage("CV"))
    power = F.when(fits["FST"] & (rated <= 200), rated).when(fits["CV"], number("CV", 3))
    fill = lambda x, new: F.when(_missing(x), F.coalesce(new, x)).otherwise(x)
    inl = fits["INL"]
    return F.struct(
        F.when(inl, number("INL", 2)).otherwise(fill(q, flow)).alias("q"),
        F.when(inl, number("INL", 3)).otherwise(fill(h, head)).alias("h"),
        F.when(inl, number("INL", 4)).otherwise(fill(p, power)).alias("p"),
        F.when(inl, speed_of_poles(whole("INL", 5))).otherwise(rpm).alias("rpm"),
    )


# Words before a name, and the shape of one of several merged names.
PHASE_WORDS = r"(?iu)^(трёхфазный|трехфазный|однофазный|3-phase|1-phase|three.?phase|single.?phase)\s*"
MERGED_NAME = r"([A-ZА-Яa-zа-я]{2,5}\s*\d+[-/]\d+\S*)"


def clean_raw_name(name: Column) -> Column:
    """Phase words off, the first of several merged names; null for what is no pump: under 3 or over 50 characters, a trailing
    ' -', digits and marks alone, or a motor (Y and E or a digit)."""
    s = F.trim(F.regexp_replace(F.trim(name), PHASE_WORDS, ""))
    names = F.regexp_extract_all(s, F.lit(MERGED_NAME), F.lit(1))
    s = F.when(F.size(names) >= 2, F.trim(F.element_at(names, 1))).otherwise(s)
    bad = (F.length(s) < 3) | (F.length(s) > 50) | F.endswith(s, F.lit(" -")) | F.translate(s, "-., ", "").rlike(r"^\d+$") | s.rlike("(?i)^Y[E2-9]")
    return F.when(~bad, s)


def is_overview(name: Column, q: Column, h: Column, p: Column) -> Column:
    """Names without '-' or '/', without flow, and without head and power together: rows of overview tables."""
    return ~(F.contains(name, F.lit("-")) | F.contains(name, F.lit("/")) | (q > 0) | ((h > 0) & (p > 0)))
