"""Queries over model records: functions, validation, repair, merging, outliers, gates, reports and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, physics
from ..functions.numbers import half_up
from ..operators import merge, quality, search
from ..sources.staging import staged
from . import oracle as O
from .inputs import ENTRIES, OUTCOMES, SOURCES, entries, outcomes, sources, table
from .registry import query

up = lambda x, n: f"floor(({x}) * {10.0**n}::DOUBLE + 0.5::DOUBLE) / {10.0**n}::DOUBLE"


@query("entries", f"WITH {ENTRIES} SELECT * FROM entries")
def _(spark, d):
    return entries(spark, d)


# ---------------------------------------------------------------- column functions


@query("f7_model_key", f"WITH {ENTRIES} SELECT model, {O.key()} AS key, {O.series()} AS series, count(*) AS n FROM entries GROUP BY ALL")
def _(spark, d):
    return entries(spark, d).groupBy("model", names.model_key(F.col("model")).alias("key"), names.series_of(F.col("model")).alias("series")).agg(F.count("*").alias("n"))


@query(
    "f8_key_variants",
    r"""WITH x AS (SELECT p_partkey, concat(p_type, ' ', p_size::varchar, '.0/', (p_partkey % 7)::varchar, ' (T)') AS name FROM part)
    SELECT p_partkey, replace(replace(replace(regexp_replace(upper(trim(name)), '\s+', '', 'g'), ',', '.'), '(', ''), ')', '') AS plain_key,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(name), '\.0([/\s-]|$)', '\1', 'g'), '\s+', ' ', 'g'), '([A-Za-z])\s+(\d)', '\1\2', 'g'), ',', '.', 'g') AS catalogue_key,
      replace(upper(trim(name)), ' ', '') AS base_key FROM x""",
)
def _(spark, d):
    name = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit(".0/"), (F.col("p_partkey") % 7).cast("string"), F.lit(" (T)"))
    x = table(spark, d, "part").select("p_partkey", name.alias("name"))
    return x.select("p_partkey", names.plain_key(F.col("name")).alias("plain_key"), names.catalogue_key(F.col("name")).alias("catalogue_key"), names.base_key(F.col("name")).alias("base_key"))


@query("f11_rpm_bands", "SELECT event_id, CASE WHEN r BETWEEN 2850 AND 2970 THEN 2900 WHEN r BETWEEN 1440 AND 1500 THEN 1450 WHEN r BETWEEN 950 AND 990 THEN 960 ELSE r END AS rpm FROM (SELECT event_id, CAST(900 + event_id % 2200 AS INTEGER) AS r FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", physics.normalise_rpm((900 + F.col("event_id") % 2200).cast("int")).alias("rpm"))


@query("f12_efficiency", f"WITH {ENTRIES} SELECT seq, {O.eta()} AS eta FROM entries")
def _(spark, d):
    return entries(spark, d).select("seq", physics.efficiency(F.col("q_nom"), F.col("h_nom"), F.col("power_kw")).alias("eta"))


@query("f13_estimate_power", f"WITH {ENTRIES} SELECT seq, {O.estimate()} AS estimated_kw FROM entries")
def _(spark, d):
    return entries(spark, d).select("seq", physics.estimate_power(F.col("q_nom"), F.col("h_nom")).alias("estimated_kw"))


@query(
    "f14_snap_power",
    f"WITH {ENTRIES}, x AS (SELECT seq, power_kw, {O.nearest()} AS nearest_kw FROM entries) SELECT seq, nearest_kw, CASE WHEN power_kw > 0 AND power_kw / nearest_kw BETWEEN 0.85::DOUBLE AND 1.15::DOUBLE THEN nearest_kw ELSE power_kw END AS snapped_kw FROM x",
)
def _(spark, d):
    p = F.col("power_kw")
    return entries(spark, d).select("seq", physics.nearest_size(p).alias("nearest_kw"), physics.snap_power(p).alias("snapped_kw"))


@query("f15_pump_type", f"WITH {ENTRIES} SELECT kind, count(*) AS n FROM (SELECT {O.pump_type()} AS kind FROM entries) GROUP BY kind")
def _(spark, d):
    kind = physics.pump_type(F.col("q_nom"), F.col("h_nom"), F.col("power_kw"), F.col("model"))
    return entries(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "f6_convert_units",
    """WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS v, ['m3/h', 'L/S', ' l/min ', 'gpm', 'unknown'][1 + l_suppkey % 5] AS qu, ['m', 'ft', 'bar', 'psi'][1 + l_suppkey % 4] AS hu, ['kW', 'hp', 'w'][1 + l_suppkey % 3] AS pu FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber,
      v * CASE lower(trim(qu)) WHEN 'l/s' THEN 3.6::DOUBLE WHEN 'l/min' THEN 0.06::DOUBLE WHEN 'gpm' THEN 0.2271::DOUBLE ELSE 1.0::DOUBLE END AS q_std,
      v * CASE hu WHEN 'ft' THEN 0.3048::DOUBLE WHEN 'bar' THEN 10.197::DOUBLE WHEN 'psi' THEN 0.7031::DOUBLE ELSE 1.0::DOUBLE END AS h_std,
      v * CASE lower(pu) WHEN 'hp' THEN 0.7457::DOUBLE WHEN 'w' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS p_std FROM x""",
)
def _(spark, d):
    from ..functions.units import convert

    unit = lambda own: F.element_at(F.array(*map(F.lit, own)), (1 + F.col("l_suppkey") % len(own)).cast("int"))
    v = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        convert(v, unit(["m3/h", "L/S", " l/min ", "gpm", "unknown"]), "q").alias("q_std"), convert(v, unit(["m", "ft", "bar", "psi"]), "h").alias("h_std"), convert(v, unit(["kW", "hp", "w"]), "p").alias("p_std"),
    )


@query("f19_completeness", f"WITH {ENTRIES} SELECT source_file, count(*) AS n, count(*) FILTER (q_nom > 0 AND h_nom > 0 AND power_kw > 0) AS n_complete FROM entries GROUP BY source_file")
def _(spark, d):
    whole = (F.col("q_nom") > 0) & (F.col("h_nom") > 0) & (F.col("power_kw") > 0)
    return entries(spark, d).groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(whole).alias("n_complete"))


@query("f18_orientation", f"WITH {ENTRIES} SELECT {O.series()} AS series, CASE WHEN {O.series()} IN ('EC', 'ST') THEN 'horizontal' ELSE 'vertical' END AS orientation, {O.series()} IN ('PR') AS flagship, count(*) AS n FROM entries GROUP BY ALL")
def _(spark, d):
    s = names.series_of(F.col("model"))
    return entries(spark, d).groupBy(s.alias("series"), names.orientation(s, ["EC", "ST"]).alias("orientation"), s.isin("PR").alias("flagship")).agg(F.count("*").alias("n"))


@query("o2_natural_sort", f"WITH {ENTRIES} SELECT model, row_number() OVER (ORDER BY lower(regexp_extract(model, '^(\\D+)', 1)), CAST(regexp_extract(model, '(\\d+)-', 1) AS INTEGER), CAST(regexp_extract(model, '-(\\d+)', 1) AS INTEGER)) AS place FROM (SELECT DISTINCT model FROM entries)")
def _(spark, d):
    models = entries(spark, d).select("model").distinct()
    # the place needs one order over the distinct models, of which there are few
    return models.select("model", F.row_number().over(Window.orderBy(names.natural_sort_key(F.col("model")))).cast("long").alias("place"))


# ---------------------------------------------------------------- validation and repair


@query("v1_validate_physics", f"WITH {ENTRIES}, {O.checked()} SELECT seq, reason = 'ok' AS ok, reason, adjustment FROM checked")
def _(spark, d):
    return physics.with_checks(entries(spark, d)).select("seq", (F.col("reason") == "ok").alias("ok"), "reason", "adjustment")


@query("g20_physics_rate", f"WITH {ENTRIES}, {O.checked()} SELECT source_file, {up("avg(CASE WHEN reason = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", 6)} AS rate FROM checked GROUP BY source_file")
def _(spark, d):
    return physics.with_checks(entries(spark, d)).groupBy("source_file").agg(half_up(F.avg((F.col("reason") == "ok").cast("double")), 6).alias("rate"))


HEALED = f"""h0 AS (SELECT *, {O.eta()} AS eta, {O.eta('q_nom * ' + repr(1 / 60) + '::DOUBLE')} AS eta_q, {O.eta(h='h_nom * 10.2::DOUBLE')} AS eta_h FROM entries),
h1 AS (SELECT *, (q_nom > 0 OR h_nom > 0) AND q_nom > 0 AND power_kw > 0 AND NOT coalesce(eta BETWEEN 0.1::DOUBLE AND 0.96::DOUBLE, false) AS odd FROM h0),
h2 AS (SELECT *, odd AND q_nom > 30 AND h_nom > 0 AND coalesce(eta_q BETWEEN 0.1::DOUBLE AND 0.96::DOUBLE, false) AS by_q FROM h1),
h3 AS (SELECT *, odd AND NOT by_q AND h_nom > 0 AND h_nom < 10 AND coalesce(eta_h BETWEEN 0.1::DOUBLE AND 0.96::DOUBLE, false) AS by_h FROM h2),
h4 AS (SELECT seq, model, source_file, source_page, rpm, data_source, confidence, by_q, by_h, CASE WHEN by_q THEN {up('q_nom * ' + repr(1 / 60) + '::DOUBLE', 2)} ELSE q_nom END AS q_nom, CASE WHEN by_h THEN {up('h_nom * 10.2::DOUBLE', 1)} ELSE h_nom END AS h_nom, power_kw FROM h3),
h5 AS (SELECT * EXCLUDE (power_kw), power_kw <= 0 AND q_nom > 0 AND h_nom > 0 AS by_p, CASE WHEN power_kw <= 0 AND q_nom > 0 AND h_nom > 0 THEN {O.estimate()} ELSE power_kw END AS power_kw FROM h4),
h6 AS (SELECT *, {O.nearest()} AS near FROM h5),
healed AS (SELECT * EXCLUDE (power_kw, near, by_q, by_h, by_p), CASE WHEN power_kw > 0 AND power_kw / near BETWEEN 0.85::DOUBLE AND 1.15::DOUBLE THEN near ELSE power_kw END AS power_kw,
  list_filter([CASE WHEN by_q THEN 'flow_per_minute' END, CASE WHEN by_h THEN 'head_in_bar' END, CASE WHEN by_p THEN 'power_estimated' END,
    CASE WHEN power_kw > 0 AND power_kw / near BETWEEN 0.85::DOUBLE AND 1.15::DOUBLE AND power_kw <> near THEN 'power_snapped' END], lambda f: f IS NOT NULL) AS fixes FROM h6)"""


@query("v2_self_heal", f"WITH {ENTRIES}, {HEALED} SELECT seq, q_nom, h_nom, power_kw, array_to_string(fixes, ',') AS fixes FROM healed")
def _(spark, d):
    return quality.self_heal(entries(spark, d)).select("seq", "q_nom", "h_nom", "power_kw", F.concat_ws(",", "fixes").alias("fixes"))


def calibrated_sql(source: str, healed: str | None = None) -> str:
    usual = f"coalesce(eta BETWEEN {O.rule('kind', 2)} AND {O.rule('kind', 3)}, false)"
    total = f"""((CASE WHEN q_nom > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN h_nom > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN power_kw > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rpm > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 14.0::DOUBLE) * 0.25::DOUBLE
    + (CASE WHEN q_nom <= 0 THEN 0.2::DOUBLE WHEN reason <> 'ok' THEN 0.1::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.8::DOUBLE + adjustment + CASE WHEN {usual} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) END) * 0.30::DOUBLE
    + 0.5::DOUBLE * 0.20::DOUBLE
    + (CASE WHEN power_kw <= 0 THEN 0.5::DOUBLE WHEN power_kw = near2 THEN 1.0::DOUBLE WHEN power_kw / near2 BETWEEN 0.95::DOUBLE AND 1.05::DOUBLE THEN 0.9::DOUBLE WHEN power_kw / near2 BETWEEN 0.85::DOUBLE AND 1.15::DOUBLE THEN 0.7::DOUBLE WHEN power_kw / near2 BETWEEN 0.75::DOUBLE AND 1.35::DOUBLE THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END) * 0.10::DOUBLE
    + least(confidence, 1.0::DOUBLE) * 0.15::DOUBLE"""
    if healed:
        total = f"({total}) * CASE WHEN {healed} THEN 0.90::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""{O.checked(source, "c0")},
calibrated AS (SELECT * EXCLUDE (confidence, near2, eta, kind, adjustment), {up(f"greatest(0.05::DOUBLE, least(0.99::DOUBLE, {total}))", 3)} AS confidence FROM (SELECT *, {O.nearest()} AS near2 FROM c0))"""


@query("v3_calibrate", f"WITH {ENTRIES}, {calibrated_sql('entries')} SELECT seq, confidence FROM calibrated")
def _(spark, d):
    return quality.calibrate(entries(spark, d)).select("seq", "confidence")


@query("v7_gate_filter", f"WITH {ENTRIES}, {calibrated_sql('entries')} SELECT source_file, count(*) AS n_kept FROM calibrated WHERE confidence >= 0.7::DOUBLE GROUP BY source_file")
def _(spark, d):
    # counted, not filtered: a filter would be worked into all expressions that make the confidence
    return quality.calibrate(entries(spark, d)).groupBy("source_file").agg(F.count_if(F.col("confidence") >= 0.7).alias("n_kept")).where("n_kept > 0")


@query(
    "q4_garbage_models",
    r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat(substr(p_type, 1, 2), ' ', p_size::varchar) WHEN 1 THEN p_size::varchar WHEN 2 THEN concat('DN ', p_size::varchar) WHEN 3 THEN p_name
        WHEN 4 THEN concat('CDM', p_size::varchar, ' CDM', p_size::varchar, ' x') WHEN 5 THEN concat('AB 4. CD', p_size::varchar) WHEN 6 THEN concat('Material ', p_size::varchar) ELSE 'A1' END AS model FROM part)
    SELECT p_partkey, model, length(trim(model)) < 3 OR NOT regexp_matches(trim(model), '[0-9]') OR NOT regexp_matches(trim(model), '^[A-Za-z]{2,}[\s\-_]?[0-9]')
      OR regexp_matches(lower(trim(model)), 'aisi|astm|description|applications|material') OR regexp_matches(lower(trim(model)), '^(npsh|dn|in |ll |dh |ye)')
      OR (len(regexp_split_to_array(trim(model), '\s+')) >= 3 AND len(list_filter(regexp_split_to_array(trim(model), '\s+'), lambda t: regexp_matches(t, '^[A-Z]{2,}[0-9]'))) >= 2)
      OR regexp_matches(trim(model), '[0-9]\.\s+[A-Z]') OR length(trim(model)) > 40 AS garbage FROM x""",
)
def _(spark, d):
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    model = (
        F.when(k == 0, F.concat(F.substring("p_type", 1, 2), F.lit(" "), size)).when(k == 1, size).when(k == 2, F.concat(F.lit("DN "), size)).when(k == 3, F.col("p_name"))
        .when(k == 4, F.concat(F.lit("CDM"), size, F.lit(" CDM"), size, F.lit(" x"))).when(k == 5, F.concat(F.lit("AB 4. CD"), size)).when(k == 6, F.concat(F.lit("Material "), size)).otherwise("A1")
    )
    return table(spark, d, "part").select("p_partkey", model.alias("model")).withColumn("garbage", names.is_garbage(F.col("model")))


@query("q5_basic_valid", f"WITH {ENTRIES} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(model) < 2 THEN 'empty_model' WHEN q_nom < 0 OR h_nom < 0 THEN 'negative' WHEN q_nom > 100000 OR h_nom > 5000 THEN 'unrealistic' WHEN power_kw < 0 OR power_kw > 20000 THEN 'bad_power' WHEN q_nom = 0 AND h_nom = 0 THEN 'no_point' ELSE 'ok' END AS reason FROM entries) GROUP BY reason")
def _(spark, d):
    return entries(spark, d).groupBy(physics.basic_reason(F.col("model"), F.col("q_nom"), F.col("h_nom"), F.col("power_kw")).alias("reason")).agg(F.count("*").alias("n"))


@query("q6_physics_valid", f"WITH {ENTRIES}, {O.checked()} SELECT seq, model, confidence FROM checked WHERE reason = 'ok' AND confidence >= 0.6::DOUBLE")
def _(spark, d):
    return physics.with_checks(entries(spark, d).where("confidence >= 0.6D")).where("reason = 'ok'").select("seq", "model", "confidence")


@query("q12_reset_impossible", f"WITH {ENTRIES}, x AS (SELECT *, q_nom > 45 OR h_nom > 100 OR power_kw > 15 AS wild, power_kw > 0 AND q_nom > 0 AND h_nom > 0 AND {O.hydraulic()} / power_kw > 3 AS odd FROM entries) SELECT seq, CASE WHEN wild OR odd THEN 0.0::DOUBLE ELSE q_nom END AS q_nom, CASE WHEN wild OR odd THEN 0.0::DOUBLE ELSE h_nom END AS h_nom, CASE WHEN wild THEN 0.0::DOUBLE ELSE power_kw END AS power_kw FROM x")
def _(spark, d):
    return search.reset_impossible(entries(spark, d), q_max=45, h_max=100, p_max=15).select("seq", "q_nom", "h_nom", "power_kw")


@query("q13_gap_worklist", f"WITH {ENTRIES} SELECT seq, source_page, unnest(list_filter([CASE WHEN q_nom = 0 THEN 'q_nom' END, CASE WHEN h_nom = 0 THEN 'h_nom' END, CASE WHEN power_kw = 0 THEN 'power_kw' END, CASE WHEN rpm = 0 THEN 'rpm' END], lambda a: a IS NOT NULL)) AS missing FROM entries")
def _(spark, d):
    return search.gap_worklist(entries(spark, d), ["q_nom", "h_nom", "power_kw", "rpm"]).select("seq", "source_page", "missing")


# ---------------------------------------------------------------- merging

LACK = f"{up('-(confidence + CASE WHEN q_nom > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN h_nom > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN power_kw > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rpm > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)', 6)}"


def merged_sql(source: str) -> str:
    score = "confidence + CASE WHEN q_nom > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN h_nom > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN power_kw > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rpm > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
    first = lambda x, cond: f"arg_min({x}, r) FILTER ({cond})"
    return f"""m0 AS (SELECT *, {O.key()} AS key, row_number() OVER (PARTITION BY {O.key()} ORDER BY {up(score, 6)} DESC, {O.ORDER}) AS r FROM {source}),
merged AS (SELECT key, {first("model", "true")} AS model, coalesce({first("q_nom", "q_nom > 0")}, 0.0::DOUBLE) AS q_nom, coalesce({first("h_nom", "h_nom > 0")}, 0.0::DOUBLE) AS h_nom,
  coalesce({first("power_kw", "power_kw > 0")}, 0.0::DOUBLE) AS power_kw, coalesce({first("rpm", "rpm > 0")}, 0) AS rpm, max(confidence) AS confidence, count(*) AS n_pages
  FROM m0 WHERE key <> '' GROUP BY key)"""


@query("w3_cross_page_merge", f"WITH {ENTRIES}, {merged_sql('entries')} SELECT * FROM merged")
def _(spark, d):
    return merge.cross_page_merge(entries(spark, d))


CURVED = """curved AS (SELECT *, CASE WHEN seq % 3 = 0 THEN concat('A', seq % 7) WHEN seq % 3 = 1 THEN '' END AS article, CASE WHEN seq % 4 = 0 THEN seq % 5 ELSE 0 END AS stages, CASE WHEN seq % 6 = 0 THEN 50 ELSE 0 END AS dn_suction, CASE WHEN seq % 5 = 0 THEN '400 V' END AS voltage, CASE WHEN seq % 10 = 0 THEN 3 WHEN seq % 10 = 1 THEN 2 ELSE 0 END AS n_points FROM entries)"""
LACK2 = f"{up('confidence + ' + ' + '.join(f'CASE WHEN {c} THEN {p}::DOUBLE ELSE 0.0::DOUBLE END' for c, p in (('q_nom > 0', 1.0), ('h_nom > 0', 1.0), ('power_kw > 0', 1.0), ('rpm > 0', 0.5), ("article <> ''", 0.5), ('stages > 0', 0.3), ('dn_suction > 0', 0.3), ('n_points >= 3', 3.0))), 6)}"


@query(
    "w3_merged_fields",
    f"""WITH {ENTRIES}, {CURVED}, r AS (SELECT *, {O.key()} AS key, row_number() OVER (PARTITION BY {O.key()} ORDER BY {LACK2} DESC, {O.ORDER}) AS r FROM curved)
    SELECT key, arg_min(model, r) AS model, coalesce(arg_min(q_nom, r) FILTER (q_nom > 0), 0.0::DOUBLE) AS q_nom, coalesce(arg_min(power_kw, r) FILTER (power_kw > 0), 0.0::DOUBLE) AS power_kw, coalesce(arg_min(stages, r) FILTER (stages > 0), 0) AS stages, coalesce(arg_min(dn_suction, r) FILTER (dn_suction > 0), 0) AS dn_suction,
      arg_min(article, r) FILTER (article <> '') AS article, arg_min(voltage, r) FILTER (voltage <> '') AS voltage, arg_min(seq, r) FILTER (n_points >= 3) AS curve_of, max(confidence) AS confidence, count(*) AS n_pages FROM r WHERE key <> '' GROUP BY key""",
)
def _(spark, d):
    entries(spark, d).createOrReplaceTempView("entries")
    own = spark.sql(f"WITH {CURVED} SELECT * FROM curved")
    points = F.when(F.col("n_points") > 0, F.transform(F.sequence(F.lit(1), F.col("n_points")), lambda i: F.col("seq") * 1.0))
    out = merge.cross_page_merge(own.withColumns({"q_points": points, "h_points": points}).drop("n_points"))
    return out.select("key", "model", "q_nom", "power_kw", "stages", "dn_suction", "article", "voltage", F.get("q_points", F.lit(0)).cast("long").alias("curve_of"), "confidence", "n_pages")


@query("w3_merged_pages", f"WITH {ENTRIES}, p AS (SELECT {O.key()} AS key, source_file, source_page, count(*) AS n FROM entries GROUP BY ALL) SELECT key, source_file, source_page, n FROM p WHERE key <> '' AND key IN (SELECT key FROM p GROUP BY key HAVING sum(n) > 1)")
def _(spark, d):
    return merge.merged_pages(entries(spark, d))


@query("w1_first_per_page", f"WITH {ENTRIES} SELECT source_file, source_page, name, seq, q_nom FROM (SELECT *, upper(model) AS name, row_number() OVER (PARTITION BY source_file, source_page, upper(model) ORDER BY {O.ORDER}) AS r FROM entries) WHERE r = 1")
def _(spark, d):
    own = entries(spark, d).withColumn("name", F.upper("model")).select("source_file", "source_page", "name", "seq", "q_nom", "h_nom", "confidence")
    order = [F.col(x) for x in merge.ORDER]
    return merge.first_per_key(own, ["source_file", "source_page", "name"], order).select("source_file", "source_page", "name", "seq", "q_nom")


SCORE2 = "CASE data_source WHEN 'catalog_curve' THEN 4 WHEN 'catalog_nominal' THEN 2 ELSE 0 END + CASE WHEN h_nom > 0 THEN 2 ELSE 0 END + CASE WHEN power_kw > 0 THEN 1 ELSE 0 END + CAST(floor(confidence * 2) AS INTEGER)"


@query("w2_best_per_key", f"WITH {ENTRIES} SELECT key, seq, q_nom, score FROM (SELECT *, {O.key()} AS key, {SCORE2} AS score, row_number() OVER (PARTITION BY {O.key()} ORDER BY {SCORE2} DESC, {O.ORDER}) AS r FROM entries) WHERE r = 1")
def _(spark, d):
    own = entries(spark, d).withColumn("key", names.model_key(F.col("model"))).withColumn("score", search.source_score())
    return merge.first_per_key(own, ["key"], [-F.col("score"), *(F.col(x) for x in merge.ORDER)]).select("key", "seq", "q_nom", "score")


@query(
    "g3_majority_fill",
    f"""WITH {ENTRIES}, s AS (SELECT *, CASE WHEN {O.series()} = '' THEN 'unknown' ELSE {O.series()} END AS sk FROM entries),
    best AS (SELECT sk, rpm AS majority FROM (SELECT sk, rpm, row_number() OVER (PARTITION BY sk ORDER BY count(*) DESC, rpm) AS r FROM s WHERE rpm > 0 GROUP BY sk, rpm) WHERE r = 1),
    sizes AS (SELECT sk, count(*) AS n FROM s GROUP BY sk)
    SELECT seq, CASE WHEN rpm > 0 THEN rpm WHEN n >= 2 THEN coalesce(majority, rpm) ELSE rpm END AS rpm FROM s LEFT JOIN best USING (sk) JOIN sizes USING (sk)""",
)
def _(spark, d):
    return merge.majority_fill(entries(spark, d)).select("seq", F.col("rpm_filled").alias("rpm"))


def _agree(a, b):
    return f"abs({a} - {b}) / greatest(abs({a}), abs({b})) <= 0.05::DOUBLE"


MERGED_VALUE = f"""CASE WHEN d_q > 0 AND v_q > 0 AND o_q > 0 AND {_agree("d_q", "v_q")} AND {_agree("d_q", "o_q")} THEN {{'value': d_q, 'confidence': 1.0::DOUBLE, 'source': 'docling+vlm+ocr'}}
 WHEN d_q > 0 AND v_q > 0 AND o_q > 0 AND {_agree("d_q", "o_q")} THEN {{'value': d_q, 'confidence': 0.8::DOUBLE, 'source': 'docling+ocr'}}
 WHEN d_q > 0 AND v_q > 0 AND o_q > 0 AND {_agree("v_q", "o_q")} THEN {{'value': v_q, 'confidence': 0.7::DOUBLE, 'source': 'vlm+ocr'}}
 WHEN d_q > 0 AND v_q > 0 AND o_q > 0 AND {_agree("d_q", "v_q")} THEN {{'value': d_q, 'confidence': 0.8::DOUBLE, 'source': 'docling+vlm'}}
 WHEN d_q > 0 AND v_q > 0 AND o_q > 0 THEN {{'value': o_q, 'confidence': 0.4::DOUBLE, 'source': 'ocr(conflict)'}}
 WHEN d_q > 0 AND v_q > 0 AND {_agree("d_q", "v_q")} THEN {{'value': d_q, 'confidence': 0.8::DOUBLE, 'source': 'docling+vlm'}}
 WHEN d_q > 0 AND v_q > 0 THEN {{'value': d_q, 'confidence': 0.5::DOUBLE, 'source': 'docling(conflict)'}}
 WHEN d_q > 0 AND o_q > 0 AND {_agree("d_q", "o_q")} THEN {{'value': d_q, 'confidence': 0.8::DOUBLE, 'source': 'docling+ocr'}}
 WHEN d_q > 0 AND o_q > 0 THEN {{'value': o_q, 'confidence': 0.5::DOUBLE, 'source': 'ocr(conflict)'}}
 WHEN v_q > 0 AND o_q > 0 AND {_agree("v_q", "o_q")} THEN {{'value': v_q, 'confidence': 0.7::DOUBLE, 'source': 'vlm+ocr'}}
 WHEN v_q > 0 AND o_q > 0 THEN {{'value': o_q, 'confidence': 0.5::DOUBLE, 'source': 'ocr(conflict)'}}
 WHEN d_q > 0 THEN {{'value': d_q, 'confidence': 0.6::DOUBLE, 'source': 'docling'}} WHEN v_q > 0 THEN {{'value': v_q, 'confidence': 0.5::DOUBLE, 'source': 'vlm'}}
 WHEN o_q > 0 THEN {{'value': o_q, 'confidence': 0.5::DOUBLE, 'source': 'ocr'}} ELSE {{'value': 0.0::DOUBLE, 'confidence': 0.0::DOUBLE, 'source': ''}} END"""


@query("j1_merge_sources", f"WITH {SOURCES}, x AS (SELECT key, {MERGED_VALUE} AS m FROM sources) SELECT key, m.value AS value, m.confidence AS confidence, m.source AS source FROM x")
def _(spark, d):
    s = sources(spark, d).withColumn("seq", F.col("key"))
    one = lambda c: s.select("key", "seq", F.col(c).alias("q")).where("q > 0")  # noqa: E731  each source has its own rows only
    return merge.merge_sources(one("d_q"), one("v_q"), one("o_q"), ["q"]).select("key", "q.value", "q.confidence", "q.source")


@query("j2_fill_from_source", f"WITH {SOURCES} SELECT key, CASE WHEN v_q > 0 THEN v_q WHEN d_q > 0 THEN d_q ELSE v_q END AS q FROM sources")
def _(spark, d):
    s = sources(spark, d)
    return merge.fill_from(s.select("key", F.col("v_q").alias("q")), s.select("key", F.col("d_q").alias("q")), "key", ["q"])


@query(
    "j3_rank_pair_join",
    f"""WITH {ENTRIES}, a AS (SELECT *, {up("q_nom", 1)} AS q1, {up("power_kw", 2)} AS p1 FROM entries WHERE power_kw > 0),
    l AS (SELECT q1, p1, seq AS left_seq, row_number() OVER (PARTITION BY q1, p1 ORDER BY source_page, seq) AS r FROM a WHERE data_source = 'catalog_curve'),
    g AS (SELECT q1, p1, seq AS right_seq, h_nom, row_number() OVER (PARTITION BY q1, p1 ORDER BY h_nom, seq) AS r FROM a WHERE data_source <> 'catalog_curve')
    SELECT left_seq, right_seq, h_nom FROM l JOIN g USING (q1, p1, r)""",
)
def _(spark, d):
    a = entries(spark, d).where("power_kw > 0").withColumns({"q1": half_up(F.col("q_nom"), 1), "p1": half_up(F.col("power_kw"), 2)})
    left = a.where("data_source = 'catalog_curve'").select("q1", "p1", F.col("seq").alias("left_seq"), "source_page")
    right = a.where("data_source <> 'catalog_curve'").select("q1", "p1", F.col("seq").alias("right_seq"), "h_nom")
    return merge.rank_pair_join(left, right, ["q1", "p1"], [F.col("source_page"), F.col("left_seq")], [F.col("h_nom"), F.col("right_seq")]).select("left_seq", "right_seq", "h_nom")


@query(
    "j6_prefix_join",
    f"""WITH {ENTRIES}, m AS (SELECT DISTINCT {O.key()} AS key FROM entries), g AS (SELECT {O.key()}[1:4] AS prefix, max(q_nom) AS group_q, count(*) AS n FROM entries WHERE data_source = 'catalog_curve' GROUP BY 1)
    SELECT key, prefix, group_q, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(prefix) DESC) AS r FROM m LEFT JOIN g ON starts_with(key, prefix)) WHERE r = 1""",
)
def _(spark, d):
    own = entries(spark, d).withColumn("key", names.model_key(F.col("model")))
    groups = own.where("data_source = 'catalog_curve'").groupBy(F.substring("key", 1, 4).alias("prefix")).agg(F.max("q_nom").alias("group_q"), F.count("*").alias("n"))
    return merge.prefix_join(own.select("key").distinct(), groups)


@query(
    "j10_cross_catalog_donor",
    f"""WITH {ENTRIES}, k AS (SELECT *, {O.key()} AS key FROM entries), dn AS (SELECT key, q_nom AS dq, h_nom AS dh FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, {O.ORDER}) AS r FROM k WHERE data_source <> 'estimated') WHERE r = 1)
    SELECT seq, CASE WHEN data_source = 'estimated' AND dq IS NOT NULL THEN dq ELSE q_nom END AS q_nom, CASE WHEN data_source = 'estimated' AND dq IS NOT NULL THEN dh ELSE h_nom END AS h_nom, data_source = 'estimated' AND dq IS NOT NULL AS from_donor FROM k LEFT JOIN dn USING (key)""",
)
def _(spark, d):
    own = entries(spark, d).withColumn("key", names.model_key(F.col("model")))
    estimated = F.col("data_source") == "estimated"
    return merge.donor_fill(own, "key", ~estimated, estimated, F.col("confidence"), ["q_nom", "h_nom"]).select("seq", "q_nom", "h_nom", "from_donor")


@query(
    "w11_body_spread",
    f"""WITH {ENTRIES}, k AS (SELECT *, regexp_extract({O.key()}, '^([A-Z]+\\d+)', 1) AS body FROM entries),
    dn AS (SELECT body, q_nom AS dq, h_nom AS dh, confidence AS dc FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY h_nom DESC, {O.ORDER}) AS r FROM k WHERE data_source <> 'estimated') WHERE r = 1)
    SELECT seq, body, CASE WHEN e THEN dq ELSE q_nom END AS q_nom, CASE WHEN e THEN dh ELSE h_nom END AS h_nom, CASE WHEN e THEN greatest(dc * 0.95::DOUBLE, 0.7::DOUBLE) ELSE confidence END AS confidence
    FROM (SELECT *, data_source = 'estimated' AND dq IS NOT NULL AS e FROM k LEFT JOIN dn USING (body))""",
)
def _(spark, d):
    own = entries(spark, d).withColumn("body", F.regexp_extract(names.model_key(F.col("model")), r"^([A-Z]+\d+)", 1)).withColumn("donor_conf", F.col("confidence"))
    estimated = F.col("data_source") == "estimated"
    out = merge.donor_fill(own, "body", ~estimated, estimated, F.col("h_nom"), ["q_nom", "h_nom", "donor_conf"])
    conf = F.when(F.col("from_donor"), F.greatest(F.col("donor_conf") * 0.95, F.lit(0.7))).otherwise(F.col("confidence"))
    return out.select("seq", "body", "q_nom", "h_nom", conf.alias("confidence"))


ONE_PER_MODEL = f"one AS (SELECT {O.key()} AS key, max(model) AS model, min(q_nom) AS q, min(power_kw) AS p FROM entries GROUP BY 1)"


@query(
    "j11_neighbour_fill",
    f"""WITH {ENTRIES}, {ONE_PER_MODEL}, w AS (SELECT key, q, p, regexp_extract(key, '^(.+\\D)\\d+$', 1) AS stem, CAST(regexp_extract(key, '(\\d+)$', 1) AS INTEGER) AS num FROM one),
    a AS (SELECT w.key, o.p AS ap, row_number() OVER (PARTITION BY w.key ORDER BY dl) AS r FROM w, (SELECT unnest([-1, 1]) AS dl) JOIN one o ON o.key = concat(stem, (num + dl)::varchar) WHERE o.p > 0)
    SELECT w.key, CASE WHEN p > 0 THEN p ELSE coalesce(ap, p) END AS p, CASE WHEN p <= 0 AND ap IS NOT NULL THEN 0.3::DOUBLE END AS p_fill_confidence FROM w LEFT JOIN a ON a.key = w.key AND r = 1""",
)
def _(spark, d):
    one = entries(spark, d).groupBy(names.model_key(F.col("model")).alias("key")).agg(F.min("q_nom").alias("q"), F.min("power_kw").alias("p"))
    stem, number = F.regexp_extract("key", r"^(.+\D)\d+$", 1), F.regexp_extract("key", r"(\d+)$", 1).try_cast("int")
    near = F.array(*(F.struct(F.concat(stem, (number + k).cast("string")).alias("key"), F.lit(0.3).alias("confidence")) for k in (-1, 1)))
    return merge.alternate_fill(one, "key", near, ["p"]).select("key", "p", "p_fill_confidence")


@query(
    "j13_suffix_antijoin",
    """WITH c AS (SELECT concat(substr(p_type, 1, 2), p_size::varchar) AS key, true AS whole FROM part GROUP BY 1 UNION ALL SELECT p_size::varchar AS key, false AS whole FROM part GROUP BY 1 UNION ALL SELECT concat('x', p_size::varchar) AS key, false AS whole FROM part GROUP BY 1)
    SELECT key, whole FROM c WHERE whole OR NOT EXISTS (SELECT 1 FROM c w WHERE w.whole AND w.key <> c.key AND ends_with(w.key, c.key))""",
)
def _(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size").cast("string")
    keys = p.select(F.concat(F.substring("p_type", 1, 2), size).alias("key"), F.lit(True).alias("whole")).distinct()
    short = p.select(size.alias("key"), F.lit(False).alias("whole")).distinct().union(p.select(F.concat(F.lit("x"), size).alias("key"), F.lit(False).alias("whole")).distinct())
    return merge.drop_suffix_twins(keys.union(short), "key", F.col("whole")).select("key", "whole")


@query(
    "j12_same_frame_fill",
    f"""WITH {ENTRIES}, {ONE_PER_MODEL}, f AS (SELECT *, regexp_extract(key, '^[A-Z]+(\\d+)', 1) AS frame FROM one), dn AS (SELECT frame, arg_min(p, key) AS dp FROM f WHERE p > 0 AND q > 0 GROUP BY frame)
    SELECT key, CASE WHEN p > 0 THEN p ELSE coalesce(dp, p) END AS p FROM f LEFT JOIN dn USING (frame)""",
)
def _(spark, d):
    one = entries(spark, d).groupBy(names.model_key(F.col("model")).alias("key")).agg(F.min("q_nom").alias("q"), F.min("power_kw").alias("p"))
    framed = one.withColumn("frame", F.regexp_extract("key", r"^[A-Z]+(\d+)", 1))
    donors = framed.where("p > 0 AND q > 0").groupBy("frame").agg(F.min_by("p", "key").alias("p"))
    return merge.fill_from(framed, donors, "frame", ["p"]).select("key", "p")


@query("j9_per_model_enrich", f"WITH {ENTRIES}, b AS (SELECT {O.key()} AS key, max(q_nom) AS bq, max(power_kw) AS bp FROM entries WHERE data_source = 'catalog_curve' GROUP BY 1) SELECT seq, coalesce(bq, q_nom) AS q_nom, CASE WHEN power_kw > 0 THEN power_kw ELSE coalesce(bp, power_kw) END AS power_kw, CASE WHEN bq IS NOT NULL THEN 'enriched' ELSE data_source END AS data_source FROM (SELECT *, {O.key()} AS key FROM entries) LEFT JOIN b USING (key)")
def _(spark, d):
    own = entries(spark, d).withColumn("key", names.model_key(F.col("model")))
    best = own.where("data_source = 'catalog_curve'").groupBy("key").agg(F.max("q_nom").alias("bq"), F.max("power_kw").alias("bp"))
    p = F.when(F.col("power_kw") > 0, F.col("power_kw")).otherwise(F.coalesce("bp", "power_kw"))
    return own.join(best, "key", "left").select("seq", F.coalesce("bq", "q_nom").alias("q_nom"), p.alias("power_kw"), F.when(F.col("bq").isNotNull(), "enriched").otherwise(F.col("data_source")).alias("data_source"))


@query("j5_append_unmatched", f"WITH {ENTRIES}, a AS (SELECT DISTINCT {O.key()} AS key FROM entries WHERE data_source = 'catalog_curve'), b AS (SELECT DISTINCT {O.key()} AS key FROM entries WHERE data_source <> 'catalog_curve' AND q_nom > 20) SELECT key, 'left' AS side FROM a UNION ALL SELECT key, 'right' AS side FROM b WHERE key NOT IN (SELECT key FROM a)")
def _(spark, d):
    own = entries(spark, d).withColumn("key", names.model_key(F.col("model")))
    a = own.where("data_source = 'catalog_curve'").select("key").distinct()
    b = own.where("data_source <> 'catalog_curve' AND q_nom > 20").select("key").distinct()
    return a.withColumn("side", F.lit("left")).unionByName(b.join(a, "key", "left_anti").withColumn("side", F.lit("right")))


@query("u2_key_sets", f"WITH {ENTRIES}, a AS (SELECT DISTINCT {O.key()} AS key FROM entries WHERE data_source = 'catalog_curve'), b AS (SELECT DISTINCT {O.key()} AS key FROM entries WHERE data_source = 'estimated') SELECT (SELECT count(*) FROM (SELECT key FROM a INTERSECT SELECT key FROM b)) AS common, (SELECT count(*) FROM (SELECT key FROM a EXCEPT SELECT key FROM b)) AS missing, (SELECT count(*) FROM (SELECT key FROM b EXCEPT SELECT key FROM a)) AS added")
def _(spark, d):
    own = entries(spark, d).withColumn("key", names.model_key(F.col("model")))
    sides = own.groupBy("key").agg(F.bool_or(F.col("data_source") == "catalog_curve").alias("a"), F.bool_or(F.col("data_source") == "estimated").alias("b"))
    return sides.agg(F.count_if(F.col("a") & F.col("b")).alias("common"), F.count_if(F.col("a") & ~F.col("b")).alias("missing"), F.count_if(~F.col("a") & F.col("b")).alias("added"))


@query("u3_append_new_only", f"WITH {ENTRIES}, k AS (SELECT *, {O.key()} AS key FROM entries), a AS (SELECT key, seq FROM k WHERE data_source = 'catalog_curve'), n AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY {O.ORDER}) AS r FROM k WHERE data_source <> 'catalog_curve' AND key NOT IN (SELECT key FROM a)) SELECT key, seq FROM a UNION ALL SELECT key, seq FROM n WHERE r = 1")
def _(spark, d):
    own = entries(spark, d).withColumn("key", names.model_key(F.col("model"))).select("key", "seq", "q_nom", "h_nom", "confidence", "data_source")
    return merge.append_new_only(own.where("data_source = 'catalog_curve'"), own.where("data_source <> 'catalog_curve'"), "key", [F.col(x) for x in merge.ORDER]).select("key", "seq")


@query("u1_union_results", f"WITH {ENTRIES} SELECT data_source, count(*) AS n FROM (SELECT seq, data_source FROM entries UNION ALL SELECT p_partkey, 'part' FROM part) GROUP BY data_source")
def _(spark, d):
    more = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.lit("part").alias("data_source"))
    return entries(spark, d).select("seq", "model", "data_source").unionByName(more, allowMissingColumns=True).groupBy("data_source").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- outliers


def rank_sql(value: str, percent: int) -> str:
    return f"list_sort(list({value}))[1 + CAST(least(floor(count({value}) * {percent} / 100), count({value}) - 1) AS INTEGER)]"


def _iqr(x):
    return f"""{x}_l AS (SELECT sk, lo - 3.0::DOUBLE * (hi - lo) AS {x}_low, hi + 3.0::DOUBLE * (hi - lo) AS {x}_high FROM (SELECT sk, {rank_sql(x, 25)} AS lo, {rank_sql(x, 75)} AS hi FROM s WHERE {x} > 0 GROUP BY sk HAVING count(*) >= 5) WHERE hi > lo)"""


@query(
    "w5_iqr_outliers",
    f"""WITH {ENTRIES}, s AS (SELECT *, CASE WHEN {O.series()} = '' THEN 'OTHER' ELSE {O.series()} END AS sk FROM entries), {_iqr("q_nom")}, {_iqr("h_nom")}, {_iqr("power_kw")}
    SELECT seq, coalesce(q_nom > 0 AND (q_nom < q_nom_low OR q_nom > q_nom_high), false) AS q_nom_outlier, coalesce(h_nom > 0 AND (h_nom < h_nom_low OR h_nom > h_nom_high), false) AS h_nom_outlier,
      coalesce(power_kw > 0 AND (power_kw < power_kw_low OR power_kw > power_kw_high), false) AS power_kw_outlier FROM s LEFT JOIN q_nom_l USING (sk) LEFT JOIN h_nom_l USING (sk) LEFT JOIN power_kw_l USING (sk)""",
)
def _(spark, d):
    return quality.iqr_outliers(entries(spark, d)).select("seq", "q_nom_outlier", "h_nom_outlier", "power_kw_outlier")


@query(
    "w6_eta_anomaly",
    f"""WITH {ENTRIES}, s AS (SELECT *, CASE WHEN {O.series()} = '' THEN 'OTHER' ELSE {O.series()} END AS sk, {O.eta()} AS eta FROM entries),
    m AS (SELECT sk, {rank_sql("eta", 50)} AS median_eta FROM s WHERE eta > 0.01::DOUBLE AND eta < 2.0::DOUBLE GROUP BY sk HAVING count(*) >= 5)
    SELECT seq, median_eta, coalesce(eta / median_eta > 3.0::DOUBLE OR eta / median_eta < 0.33::DOUBLE, false) AS eta_anomaly FROM s LEFT JOIN m USING (sk)""",
)
def _(spark, d):
    return quality.eta_anomalies(entries(spark, d)).select("seq", "median_eta", "eta_anomaly")


@query(
    "w7_same_point",
    f"""WITH {ENTRIES}, k AS (SELECT *, {up("q_nom", 1)} AS q1, {up("h_nom", 1)} AS h1, {up("power_kw", 1)} AS p1 FROM entries WHERE q_nom > 0 OR h_nom > 0),
    f AS (SELECT seq, model, first_value(model) OVER (PARTITION BY q1, h1, p1 ORDER BY {O.ORDER}) AS fm FROM k) SELECT seq, fm AS same_as FROM f WHERE upper(fm) <> upper(model)""",
)
def _(spark, d):
    return quality.same_point(entries(spark, d)).where("same_as IS NOT NULL").select("seq", "same_as")


# ---------------------------------------------------------------- gates and reports

GATES_SQL = """st AS (SELECT source_file, count(*) AS n, count(DISTINCT source_page) AS np, avg(confidence) AS mean, avg(CASE WHEN reason = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate, avg(CASE WHEN confidence < 0.4::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS low,
  CASE WHEN count(*) FILTER (q_nom > 0) >= 3 AND max(q_nom) / min(q_nom) FILTER (q_nom > 0) > 1000 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (h_nom > 0) >= 3 AND max(h_nom) / min(h_nom) FILTER (h_nom > 0) > 1000 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (power_kw > 0) >= 3 AND max(power_kw) / min(power_kw) FILTER (power_kw > 0) > 1000 THEN 1 ELSE 0 END AS wide FROM {source} GROUP BY source_file),
gt AS (SELECT source_file, unnest([
  {{'gate': 'min_models', 'value': n::DOUBLE, 'verdict': CASE WHEN n >= greatest(1.0::DOUBLE, np / 10 * 2) THEN 'pass' WHEN n >= greatest(1.0::DOUBLE, np / 10 * 2) * 0.5::DOUBLE THEN 'warn' ELSE 'fail' END}},
  {{'gate': 'avg_confidence', 'value': {m6}, 'verdict': CASE WHEN {m9} >= 0.6::DOUBLE THEN 'pass' WHEN {m9} >= 0.4::DOUBLE THEN 'warn' ELSE 'fail' END}},
  {{'gate': 'physics_rate', 'value': {r6}, 'verdict': CASE WHEN rate >= 0.8::DOUBLE THEN 'pass' WHEN rate >= 0.5::DOUBLE THEN 'warn' ELSE 'fail' END}},
  {{'gate': 'low_conf_ratio', 'value': {l6}, 'verdict': CASE WHEN low <= 0.3::DOUBLE THEN 'pass' WHEN low <= 0.5::DOUBLE THEN 'warn' ELSE 'fail' END}},
  {{'gate': 'consistency', 'value': wide::DOUBLE, 'verdict': CASE WHEN n >= 3 AND wide > 0 THEN 'warn' ELSE 'pass' END}}]) AS g FROM st)"""
GATES_ENTRIES = GATES_SQL.format(source="checked", m6=up("mean", 6), m9=up("mean", 9), r6=up("rate", 6), l6=up("low", 6))


GATES_PAGES = GATES_ENTRIES.replace("count(DISTINCT source_page) AS np", "any_value(np) AS np")


@query("g4_gates_by_pages", f"WITH {ENTRIES}, {O.checked()}, pr AS (SELECT concat('s', l_suppkey) AS source_file, count(DISTINCT l_orderkey) AS np FROM lineitem GROUP BY 1), cp AS (SELECT * FROM checked JOIN pr USING (source_file)), {GATES_PAGES.replace('FROM checked', 'FROM cp')} SELECT source_file, CASE WHEN bool_or(g.verdict = 'fail') OVER w THEN 'fail' WHEN bool_or(g.verdict = 'warn') OVER w THEN 'warn' ELSE 'pass' END AS overall, g.gate AS gate, g.value AS value, g.verdict AS verdict FROM gt WINDOW w AS (PARTITION BY source_file) UNION ALL SELECT 'empty', 'fail', unnest(['min_models', 'avg_confidence', 'physics_rate', 'low_conf_ratio', 'consistency']), unnest([0.0::DOUBLE, 0.0, 0.0, 1.0, 0.0]), unnest(['fail', 'fail', 'fail', 'fail', 'pass'])")
def _(spark, d):
    read = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_file"), F.col("l_orderkey").alias("source_page"))
    read = read.unionByName(table(spark, d, "region").select(F.lit("empty").alias("source_file"), F.col("r_regionkey").cast("long").alias("source_page")))
    return quality.quality_gates(entries(spark, d), processed=read)


@query("g4_quality_gates", f"WITH {ENTRIES}, {O.checked()}, {GATES_ENTRIES} SELECT source_file, CASE WHEN bool_or(g.verdict = 'fail') OVER w THEN 'fail' WHEN bool_or(g.verdict = 'warn') OVER w THEN 'warn' ELSE 'pass' END AS overall, g.gate AS gate, g.value AS value, g.verdict AS verdict FROM gt WINDOW w AS (PARTITION BY source_file)")
def _(spark, d):
    return quality.quality_gates(entries(spark, d))


@query("g2_extraction_score", f"WITH {ENTRIES}, {O.checked()} SELECT source_file, data_source, count(*) AS n, {up('least(count(*), 50) * 0.5::DOUBLE + avg(CASE WHEN q_nom > 0 AND h_nom > 0 AND power_kw > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 30 + avg(CASE WHEN reason = ' + chr(39) + 'ok' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 30', 1)} AS score FROM checked GROUP BY ALL")
def _(spark, d):
    return quality.extraction_score(entries(spark, d), ["source_file", "data_source"])


@query("g1_db_stats", f"WITH {ENTRIES} SELECT count(*) AS n, count(DISTINCT source_file) AS n_catalogs, {up('avg(confidence)', 6)} AS mean_confidence, count(*) FILTER (data_source = 'catalog_curve') AS n_curves FROM entries")
def _(spark, d):
    return entries(spark, d).agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("n_catalogs"), half_up(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("data_source") == "catalog_curve").alias("n_curves"))


BUCKETS = ((0.4, "<0.4"), (0.6, "0.4-0.6"), (0.7, "0.6-0.7"), (0.8, "0.7-0.8"))


@query("g5_conf_histogram", f"WITH {ENTRIES} SELECT CASE WHEN confidence < 0.4::DOUBLE THEN '<0.4' WHEN confidence < 0.6::DOUBLE THEN '0.4-0.6' WHEN confidence < 0.7::DOUBLE THEN '0.6-0.7' WHEN confidence < 0.8::DOUBLE THEN '0.7-0.8' ELSE '>=0.8' END AS bucket, count(*) AS n FROM entries GROUP BY 1")
def _(spark, d):
    bucket = F.when(F.col("confidence") < BUCKETS[0][0], BUCKETS[0][1])
    for limit, name in BUCKETS[1:]:
        bucket = bucket.when(F.col("confidence") < limit, name)
    return entries(spark, d).groupBy(bucket.otherwise(">=0.8").alias("bucket")).agg(F.count("*").alias("n"))


@query("g6_field_completeness", f"WITH {ENTRIES} SELECT source_file, {', '.join(up(f'avg(CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100', 4) + f' AS {x}_pct' for x in ('q_nom', 'h_nom', 'power_kw', 'rpm'))} FROM entries GROUP BY source_file")
def _(spark, d):
    return entries(spark, d).groupBy("source_file").agg(*(half_up(F.avg((F.col(x) > 0).cast("double")) * 100, 4).alias(f"{x}_pct") for x in ("q_nom", "h_nom", "power_kw", "rpm")))


@query("g7_source_breakdown", f"WITH {ENTRIES}, c AS (SELECT data_source, count(*) AS n FROM entries GROUP BY 1) SELECT data_source, n, {up('n * 100.0::DOUBLE / sum(n) OVER ()', 4)} AS pct FROM c")
def _(spark, d):
    counts = entries(spark, d).groupBy("data_source").agg(F.count("*").alias("n"))
    # one row for each source is all that meets in the window
    return counts.withColumn("pct", half_up(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query("g8_page_report", f"WITH {ENTRIES} SELECT source_file, source_page, data_source, count(*) AS n, {up('avg(confidence)', 6)} AS mean_confidence FROM entries GROUP BY ALL")
def _(spark, d):
    return entries(spark, d).groupBy("source_file", "source_page", "data_source").agg(F.count("*").alias("n"), half_up(F.avg("confidence"), 6).alias("mean_confidence"))


@query("g9_top_warnings", f"WITH {ENTRIES}, {O.checked()} SELECT reason, count(*) AS n FROM checked WHERE reason <> 'ok' GROUP BY reason ORDER BY n DESC, reason LIMIT 10")
def _(spark, d):
    return physics.with_checks(entries(spark, d)).groupBy("reason").agg(F.count("*").alias("n")).where("reason <> 'ok'").orderBy(F.desc("n"), "reason").limit(10)


@query("g10_brands_index", "WITH b AS (SELECT p_brand AS brand, substr(p_type, 1, 2) AS series, count(*) AS n FROM part GROUP BY ALL) SELECT brand, sum(n)::BIGINT AS n_models, string_agg(concat(series, ':', n::varchar), ',' ORDER BY series <> 'PR', n DESC, series) AS series FROM b GROUP BY brand")
def _(spark, d):
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.substring("p_type", 1, 2).alias("series")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((F.col("series") != "PR").alias("f"), (-F.col("n")).alias("m"), "series")))
    return counts.groupBy("brand").agg(F.sum("n").alias("n_models"), F.concat_ws(",", F.transform(ordered, lambda x: F.concat(x["series"], F.lit(":"), (-x["m"]).cast("string")))).alias("series"))


@query("g11_base_stats", f"WITH {ENTRIES} SELECT {O.series()} AS series, count(DISTINCT {O.key()}) AS n_models, {up('avg(CASE WHEN power_kw > 0 AND h_nom > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100', 4)} AS complete_pct FROM entries GROUP BY ROLLUP (1)")
def _(spark, d):
    whole = ((F.col("power_kw") > 0) & (F.col("h_nom") > 0)).cast("double")
    own = entries(spark, d).select(names.series_of(F.col("model")).alias("series"), names.model_key(F.col("model")).alias("key"), whole.alias("whole"))
    return own.rollup("series").agg(F.countDistinct("key").alias("n_models"), half_up(F.avg("whole") * 100, 4).alias("complete_pct"))


@query("g12_catalog_quality", f"WITH {ENTRIES} SELECT source_file, count(*) FILTER (q_nom > 0) AS q_n, count(*) FILTER (power_kw > 0) AS p_n, string_agg(DISTINCT {O.series()}, ',' ORDER BY {O.series()}) AS series FROM entries GROUP BY source_file")
def _(spark, d):
    return entries(spark, d).groupBy("source_file").agg(F.count_if(F.col("q_nom") > 0).alias("q_n"), F.count_if(F.col("power_kw") > 0).alias("p_n"), F.concat_ws(",", F.sort_array(F.collect_set(names.series_of(F.col("model"))))).alias("series"))


@query("g13_source_counts", f"WITH {ENTRIES} SELECT source_file, count(*) FILTER (data_source = 'catalog_curve') AS n_curve, count(*) FILTER (data_source = 'catalog_nominal') AS n_nominal, count(*) FILTER (data_source = 'estimated') AS n_estimated FROM entries GROUP BY source_file")
def _(spark, d):
    n = lambda s, a: F.count_if(F.col("data_source") == s).alias(a)
    return entries(spark, d).groupBy("source_file").agg(n("catalog_curve", "n_curve"), n("catalog_nominal", "n_nominal"), n("estimated", "n_estimated"))


@query("g14_ranges", f"WITH {ENTRIES} SELECT source_file, min(q_nom) FILTER (q_nom > 0) * 0.8::DOUBLE AS q_low, max(q_nom) * 1.2::DOUBLE AS q_high, min(h_nom) FILTER (h_nom > 0) * 0.8::DOUBLE AS h_low, max(h_nom) * 1.2::DOUBLE AS h_high FROM entries GROUP BY source_file")
def _(spark, d):
    low = lambda x: F.min(F.when(F.col(x) > 0, F.col(x))) * 0.8
    return entries(spark, d).groupBy("source_file").agg(low("q_nom").alias("q_low"), (F.max("q_nom") * 1.2).alias("q_high"), low("h_nom").alias("h_low"), (F.max("h_nom") * 1.2).alias("h_high"))


@query("g15_top_k_values", f"WITH {ENTRIES}, c AS (SELECT source_file, {O.series()} AS series, count(*) AS n FROM entries GROUP BY ALL) SELECT source_file, series, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY n DESC, series) AS INTEGER) AS place FROM c) WHERE place <= 3")
def _(spark, d):
    counts = entries(spark, d).groupBy("source_file", names.series_of(F.col("model")).alias("series")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("n"), "series"))).where("place <= 3")


@query("g16_verification_summary", f"WITH {ENTRIES}, e AS (SELECT *, {O.eta()} AS eta FROM entries) SELECT count(*) AS n, {up('avg(CASE WHEN power_kw > 0 AND h_nom > 0 AND q_nom > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100', 4)} AS complete_pct, count(*) FILTER (eta < 0.05::DOUBLE OR eta > 0.95::DOUBLE) AS n_bad FROM e")
def _(spark, d):
    eta = physics.efficiency(F.col("q_nom"), F.col("h_nom"), F.col("power_kw"))
    whole = (F.col("power_kw") > 0) & (F.col("h_nom") > 0) & (F.col("q_nom") > 0)
    return entries(spark, d).agg(F.count("*").alias("n"), half_up(F.avg(whole.cast("double")) * 100, 4).alias("complete_pct"), F.count_if((eta < 0.05) | (eta > 0.95)).alias("n_bad"))


@query("g17_run_summary", f"WITH {ENTRIES} SELECT source_file, data_source, count(*) AS n, count(*) FILTER (power_kw > 0) AS n_complete FROM entries GROUP BY ROLLUP (source_file, data_source)")
def _(spark, d):
    return entries(spark, d).rollup("source_file", "data_source").agg(F.count("*").alias("n"), F.count_if(F.col("power_kw") > 0).alias("n_complete"))


@query("g18_points_per_model", f"WITH {ENTRIES} SELECT {O.series()} AS series, count(*) AS n_points, count(DISTINCT model) AS n_models FROM entries GROUP BY 1")
def _(spark, d):
    return entries(spark, d).groupBy(names.series_of(F.col("model")).alias("series")).agg(F.count("*").alias("n_points"), F.countDistinct("model").alias("n_models"))


@query("g19_token_cost", f"SELECT event_type, count(*) AS n, {up('sum(value) * 0.15::DOUBLE / 1000', 3)} AS cost FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), half_up(F.sum("value") * 0.15 / 1000, 3).alias("cost"))


@query("g21_dedup_points", f"WITH {ENTRIES} SELECT DISTINCT model, {up('power_kw', 2)} AS power_kw, {up('q_nom', 1)} AS q_nom, {up('h_nom', 1)} AS h_nom FROM entries")
def _(spark, d):
    return entries(spark, d).select("model", half_up(F.col("power_kw"), 2).alias("power_kw"), half_up(F.col("q_nom"), 1).alias("q_nom"), half_up(F.col("h_nom"), 1).alias("h_nom")).distinct()


# ---------------------------------------------------------------- search


@query("q1_search_pumps", f"WITH {ENTRIES} SELECT seq, model, q_nom, h_nom, count(*) OVER () AS total FROM entries WHERE q_nom BETWEEN 10 AND 40 AND h_nom >= 20 AND model ILIKE '%ec%' AND confidence >= 0.6::DOUBLE ORDER BY model, seq LIMIT 100 OFFSET 20")
def _(spark, d):
    return search.search(entries(spark, d), q_nom=(10, 40), h_nom=(20, None), like={"model": "ec"}, min_confidence=0.6, limit=100, offset=20).select("seq", "model", "q_nom", "h_nom", "total")


@query("q2_get_by_catalog", f"WITH {ENTRIES} SELECT seq, model FROM entries WHERE source_file = 's7'")
def _(spark, d):
    return entries(spark, d).where("source_file = 's7'").select("seq", "model")


@query("q3_keyword_search", f"WITH {ENTRIES}, m AS (SELECT DISTINCT model FROM entries) SELECT model FROM m WHERE contains(lower(model), '12-') OR contains(lower(model), 'st 4') ORDER BY model LIMIT 5")
def _(spark, d):
    return search.keyword_search(entries(spark, d).select("model").distinct(), ["12-", "st 4", "ab"], ["model"], ["model"])


@query("o3_composite_order", f"WITH {ENTRIES}, c AS (SELECT {O.series()} AS series, count(*) AS n FROM entries GROUP BY 1) SELECT series, n, row_number() OVER (ORDER BY series <> 'PR', n DESC, series) AS place FROM c")
def _(spark, d):
    counts = entries(spark, d).groupBy(names.series_of(F.col("model")).alias("series")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("series") != "PR", F.desc("n"), "series")).cast("long"))


@query("o5_spot_check", f"WITH {ENTRIES} SELECT seq FROM entries WHERE power_kw > 0 ORDER BY md5(seq::varchar), {O.ORDER} LIMIT 5")
def _(spark, d):
    return search.spot_check(entries(spark, d).where("power_kw > 0"), "seq", 5).select("seq")


@query("j20_coverage", f"WITH {ENTRIES}, e AS (SELECT DISTINCT concat(substr(p_type, 1, 2), p_size::varchar, '-', (p_partkey % 20)::varchar) AS key FROM part), p AS (SELECT DISTINCT {O.key()} AS key FROM entries WHERE data_source = 'catalog_curve') SELECT count(*) AS expected, count(p.key) AS found, count(*) - count(p.key) AS missing FROM e LEFT JOIN p USING (key)")
def _(spark, d):
    expected = table(spark, d, "part").select(F.concat(F.substring("p_type", 1, 2), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 20).cast("string")).alias("key")).distinct()
    found = entries(spark, d).where("data_source = 'catalog_curve'").select(names.model_key(F.col("model")).alias("key")).distinct().withColumn("hit", F.lit(1))
    return expected.join(found, "key", "left").agg(F.count("*").alias("expected"), F.count("hit").alias("found"), (F.count("*") - F.count("hit")).alias("missing"))


@query("j18_corrections", f"WITH {ENTRIES}, c AS (SELECT {O.key()} AS key, q_nom, max(h_nom) AS ch FROM entries WHERE data_source = 'catalog_nominal' GROUP BY ALL) SELECT seq, coalesce(ch, h_nom) AS h_nom FROM (SELECT *, {O.key()} AS key FROM entries) LEFT JOIN c USING (key, q_nom)")
def _(spark, d):
    own = entries(spark, d).withColumn("key", names.model_key(F.col("model")))
    table_ = own.where("data_source = 'catalog_nominal'").groupBy("key", "q_nom").agg(F.max("h_nom").alias("ch"))
    return own.join(table_, ["key", "q_nom"], "left").select("seq", F.coalesce("ch", "h_nom").alias("h_nom"))


@query("j19_blacklist", f"WITH {ENTRIES}, b AS (SELECT p_partkey, p_retailprice FROM part WHERE p_size < 10) SELECT seq FROM entries e WHERE NOT EXISTS (SELECT 1 FROM b WHERE e.seq // 100000 % 100000 = p_partkey AND abs(e.q_nom - p_partkey % 50) <= 5.01::DOUBLE)")
def _(spark, d):
    black = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("bq"))
    own = entries(spark, d).withColumn("id", F.expr("seq div 100000 % 100000"))
    return own.join(black, (own["id"] == black["id"]) & (F.abs(own["q_nom"] - black["bq"]) <= 5.01), "left_anti").select("seq")


# ---------------------------------------------------------------- recipes

RUNS = """w0 AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY recipe_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS wins FROM outcomes),
w1 AS (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY ts, event_id) AS uses, CASE WHEN success THEN 0 ELSE row_number() OVER (PARTITION BY recipe_id, wins ORDER BY ts, event_id) - CASE WHEN wins > 0 THEN 1 ELSE 0 END END AS failures FROM w0)"""


@query("w12_consecutive_failures", f"WITH {OUTCOMES}, {RUNS} SELECT event_id, recipe_id, uses, CAST(wins AS BIGINT) AS successes, failures FROM w1")
def _(spark, d):
    from ..operators import recipes

    return recipes.histories(outcomes(spark, d)).select("event_id", "recipe_id", "uses", "successes", "failures")


@query("v6_recipe_evaluate", f"WITH {OUTCOMES}, {RUNS} SELECT recipe_id, uses, CAST(wins AS BIGINT) AS successes, failures, CASE WHEN failures >= 3 OR (uses >= 3 AND wins / uses < 0.5::DOUBLE) THEN 'delete' WHEN uses >= 3 AND wins / uses >= 0.9::DOUBLE THEN 'promote' WHEN uses >= 3 AND wins / uses < 0.7::DOUBLE THEN 'demote' ELSE 'ok' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY ts DESC, event_id DESC) AS r FROM w1) WHERE r = 1")
def _(spark, d):
    from ..operators import recipes

    return recipes.evaluate(outcomes(spark, d)).select("recipe_id", "uses", "successes", "failures", "action")


@query("m2_recipe_state", f"WITH {OUTCOMES}, {RUNS} SELECT recipe_id, uses, CAST(wins AS BIGINT) AS successes, failures, CASE WHEN failures >= 3 OR (uses >= 3 AND wins / uses < 0.5::DOUBLE) THEN 'delete' WHEN uses >= 3 AND wins / uses >= 0.9::DOUBLE THEN 'promote' WHEN uses >= 3 AND wins / uses < 0.7::DOUBLE THEN 'demote' ELSE 'ok' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY ts DESC, event_id DESC) AS r FROM w1) WHERE r = 1")
def _(spark, d):
    from ..streaming import jobs

    return jobs.replayed(outcomes(spark, d))


@query("v4_recipe_success", f"WITH {ENTRIES}, {O.checked()} SELECT source_file, count(*) >= 1 AND {up('avg(confidence)', 9)} >= 0.68::DOUBLE AND avg(CASE WHEN reason = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.8::DOUBLE AS success FROM checked GROUP BY source_file")
def _(spark, d):
    from ..operators import recipes

    return recipes.successes(entries(spark, d), confidence=0.68).select("source_file", "success")


@query(
    "v5_recipe_generate",
    f"""WITH {ENTRIES}, {O.checked()}, c AS (SELECT source_file, count(*) AS n, {up('avg(confidence)', 9)} AS mean, avg(CASE WHEN reason = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate, string_agg(DISTINCT {O.series()}, ',' ORDER BY {O.series()}) AS series,
      min(q_nom) FILTER (q_nom > 0) * 0.8::DOUBLE AS q_low, max(q_nom) * 1.2::DOUBLE AS q_high FROM checked GROUP BY source_file)
    SELECT substr(md5(concat('auto_', source_file)), 1, 12) AS recipe_id, source_file, series, q_low, q_high FROM c WHERE n >= 3 AND mean >= 0.68::DOUBLE AND rate >= 0.8::DOUBLE""",
)
def _(spark, d):
    from ..operators import recipes

    return recipes.generate(entries(spark, d), confidence=0.68)


@query(
    "w13_budget_selection",
    f"""WITH {ENTRIES}, p AS (SELECT source_file, source_page, count(*) FILTER (data_source = 'estimated') AS priority FROM entries GROUP BY ALL), r AS (SELECT *, sum(0.002::DOUBLE) OVER (PARTITION BY source_file ORDER BY priority DESC, source_page ROWS UNBOUNDED PRECEDING) AS cost, row_number() OVER (PARTITION BY source_file ORDER BY priority DESC, source_page) AS place FROM p)
    SELECT source_file, source_page, priority FROM r WHERE place <= 40 AND place <= 12""",
)
def _(spark, d):
    from ..operators import recipes

    pages = entries(spark, d).groupBy("source_file", "source_page").agg(F.count_if(F.col("data_source") == "estimated").alias("priority"))
    return recipes.within_budget(pages, "source_file", [F.desc("priority"), F.col("source_page")], cost=0.002, most_cost=0.0245, most_pages=40).select("source_file", "source_page", "priority")


# ---------------------------------------------------------------- the whole chain


@query(
    "flagship_clean_models",
    f"""WITH {ENTRIES}, {merged_sql('entries')}, base AS (SELECT row_number() OVER (ORDER BY key) AS seq, model, key AS source_file, 0 AS source_page, q_nom, h_nom, power_kw, rpm, 'merged' AS data_source, confidence FROM merged),
    {HEALED.replace("FROM entries)", "FROM base)")}, {calibrated_sql("healed", "len(fixes) > 0")}
    SELECT source_file AS key, model, q_nom, h_nom, power_kw, rpm, confidence, reason FROM calibrated WHERE confidence >= 0.5::DOUBLE""",
)
def flagship(spark, d):
    merged = merge.cross_page_merge(entries(spark, d)).where(~names.is_garbage(F.col("model")))
    healed = quality.self_heal(merged)
    # one row for each model: written and read again, so that the filter isn't worked into all expressions before it
    checked = staged(quality.calibrate(healed, healed=F.size("fixes") > 0), "clean-models")
    return checked.where("confidence >= 0.5D").select("key", "model", "q_nom", "h_nom", "power_kw", "rpm", "confidence", "reason")
