"""The chain of fills over models made of the parts: each group of seventeen parts has names that point to each other."""

from __future__ import annotations

from ..operators import fills
from .inputs import table
from .registry import query

# names by the part's place in its group g; which values a model has changes with g and the place
NAMES = [
    "concat('CDL ', g, '-80')", "concat('CDL ', g, '-80-2')", "concat('Fm', g, '/160')", "concat('F ', g, '/160')", "concat('CDM', g, '-15')", "concat('CDM', g, '-14')", "concat('CDM', g, '-14-2')", "concat('FST ', g, '-250/55-75')",
    "concat('FST ', g, '-250/55')", "concat('MATRIX CDM', g, '-15')", "concat('FS4 ', g, '-250/9,5')", "concat('Fm', g, '/160-2')", "concat('CDL ', g, '-81')", "concat('CDLm', g, '-81')", "concat('FST ', g, '-250/55-76')", "concat('CDX ', g, '-250/60')", "concat(g, '-250/60')",
]
#: Places of models that have no values of their own.
BARE = "(4, 7, 9, 12, 15)"
HAS = {"q": "(m + g) % 4 <> 0", "h": "(m * 3 + g) % 5 <> 1", "kw": "(m + g * 2) % 3 <> 2"}
MODELS = f"""models AS (SELECT k AS place, CASE m {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(NAMES))} END AS model,
    CASE WHEN m NOT IN {BARE} AND {HAS['q']} THEN k + 0.5 ELSE 0.0 END AS q, CASE WHEN m NOT IN {BARE} AND {HAS['h']} THEN k + 0.25 ELSE 0.0 END AS h, CASE WHEN m NOT IN {BARE} AND {HAS['kw']} THEN k + 0.125 ELSE 0.0 END AS kw
    FROM (SELECT p_partkey AS k, p_partkey % 17 AS m, CAST(floor(p_partkey / 17) AS INTEGER) AS g FROM part))"""
KEY_SQL = "regexp_replace(replace(upper({0}), ',', '.'), '[\\s()]+', '', 'g')"
WHOLE = "q > 0 AND h > 0 AND kw > 0"

NAMES_SQL = {
    "sibling": "[CASE WHEN ends_with(model, '-2') THEN trim(left(model, length(model) - 2)) ELSE concat(model, '-2') END]",
    "phase_variant": "[CASE WHEN regexp_matches(model, '^[A-Za-z]+?m\\d.*$') THEN regexp_replace(model, '^([A-Za-z]+?)m(\\d.*)$', '\\1 \\2') WHEN regexp_matches(model, '^[A-Za-z]+\\s+\\d.*$') THEN regexp_replace(model, '^([A-Za-z]+)\\s+(\\d.*)$', '\\1m\\2') END]",
    "neighbor": "list_transform([-1, 1], lambda d: CASE WHEN regexp_matches(model, '^.+\\D\\d+$') THEN concat(regexp_extract(model, '^(.+\\D)(\\d+)$', 1), CAST(regexp_extract(model, '^(.+\\D)(\\d+)$', 2) AS BIGINT) + d) END)",
    "range_split": "list_transform([2, 4], lambda i: CASE WHEN regexp_matches(model, '^.+/[\\d.]+[A-Za-z]?\\s*-\\s*[\\d.]+[A-Za-z]?$') THEN concat(regexp_extract(model, '^(.+/)', 1), CASE i WHEN 2 THEN regexp_extract(model, '/([\\d.]+[A-Za-z]?)\\s*-', 1) ELSE regexp_extract(model, '-\\s*([\\d.]+[A-Za-z]?)$', 1) END) END)",
    "prefix_dedup": "list_transform([0, 1], lambda i: CASE i WHEN 0 THEN trim(regexp_replace(model, '^(MATRIX|CDXM?|DWF?|DW\\s*VOX)\\s*', '')) ELSE replace(trim(regexp_replace(model, '^(MATRIX|CDXM?|DWF?|DW\\s*VOX)\\s*', '')), 'T/', '(.)/') END)",
}
FRAME_SQL = "nullif(replace(regexp_extract(model, '^(?:FST4?|FS4?|FSM|[A-Za-z]+)\\s*(\\d+\\s*-\\s*\\d+)', 1, 'i'), ' ', ''), '')"


def pass_sql(n: int, source: str, confidence: float, complete: bool, values: str = "q h kw") -> str:
    before, own = f"s{n - 1}", values.split()
    given = ", ".join(f"CASE WHEN {x} > 0 THEN {x} END AS g_{x}" for x in own)
    who = f"SELECT * FROM {before} WHERE NOT ({WHOLE})"
    if source == "same_frame":
        best = f"SELECT t.key, {', '.join(f'd.{x} AS g_{x}' for x in own)} FROM ({who} AND h <= 0) t JOIN (SELECT *, row_number() OVER (PARTITION BY {FRAME_SQL} ORDER BY place) AS r FROM {before} WHERE {WHOLE}) d ON {FRAME_SQL.replace('model', 't.model')} = {FRAME_SQL.replace('model', 'd.model')} AND r = 1"
    else:
        asked = f"SELECT key, unnest(range(0, len(ns))) AS p, {KEY_SQL.format('unnest(ns)')} AS other FROM (SELECT key, {NAMES_SQL[source]} AS ns FROM ({who}))"
        donors = f"SELECT key AS other, {given} FROM {before}" + f" WHERE {WHOLE}" * complete
        best = f"SELECT key, {', '.join(f'arg_min(g_{x}, p) FILTER (g_{x} IS NOT NULL) AS g_{x}' for x in own)} FROM ({asked}) JOIN ({donors}) USING (other) GROUP BY key"
    take = lambda x: f"a.{x} <= 0 AND b.g_{x} IS NOT NULL"
    columns = [f"CASE WHEN {take(x)} THEN b.g_{x} ELSE a.{x} END AS {x}, CASE WHEN {take(x)} THEN {confidence}::DOUBLE ELSE a.confidence_{x} END AS confidence_{x}, CASE WHEN {take(x)} THEN '{source}' ELSE a.source_{x} END AS source_{x}" if x in own else f"a.{x}, a.confidence_{x}, a.source_{x}" for x in ("q", "h", "kw")]
    return f"s{n} AS MATERIALIZED (SELECT a.key, a.place, a.model, {', '.join(columns)} FROM {before} a LEFT JOIN ({best}) b ON a.key = b.key)"


ORDER = [("sibling", 0.4, False), ("phase_variant", 0.35, False), ("neighbor", 0.3, True), ("range_split", 0.3, True), ("same_frame", 0.25, True), ("prefix_dedup", 0.35, True, "q h")]
START = f"s0 AS (SELECT {KEY_SQL.format('model')} AS key, place, model, {', '.join(f'{x}::DOUBLE AS {x}, NULL::DOUBLE AS confidence_{x}, NULL::VARCHAR AS source_{x}' for x in ('q', 'h', 'kw'))} FROM models)"
RESULT = "place, model, " + ", ".join(f"{x}, confidence_{x}, source_{x}" for x in ("q", "h", "kw"))


def chain_sql(order: list[tuple]) -> str:
    return f"WITH {MODELS}, {START}, {', '.join(pass_sql(n, *x) for n, x in enumerate(order, 1))} SELECT {RESULT} FROM s{len(order)}"


@query("j11_fill_chain", chain_sql(ORDER))
def _(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    models = spark.sql(f"WITH {MODELS} SELECT * FROM models").selectExpr("place", "model", *(f"CAST({x} AS DOUBLE) AS {x}" for x in fills.VALUES))
    return fills.fill_chain(models).selectExpr(*RESULT.split(", "))
