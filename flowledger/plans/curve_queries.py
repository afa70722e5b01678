"""Queries over Q-H curves: arrays and their long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import physics
from ..operators import curve_ops
from .inputs import CURVE_POINTS, curve_points
from .registry import query

CURVES = f"WITH {CURVE_POINTS}, curves AS (SELECT model_id, list(q ORDER BY q) AS qs, list(h ORDER BY q) AS hs FROM curve_points GROUP BY model_id)"
up = lambda x, n: f"floor(({x}) * {10.0**n}::DOUBLE + 0.5::DOUBLE) / {10.0**n}::DOUBLE"


def curves(spark, d) -> DataFrame:
    return curve_ops.to_arrays(curve_points(spark, d), ["model_id"])


@query("curve_points", f"WITH {CURVE_POINTS} SELECT * FROM curve_points")
def _(spark, d):
    return curve_points(spark, d)


@query("a9_points_to_curves", f"{CURVES} SELECT model_id, len(qs) AS n, array_to_string(qs, ';') AS qs FROM curves")
def _(spark, d):
    # whole numbers print alike once they are integers
    return curves(spark, d).select("model_id", F.size("q_points").cast("long").alias("n"), F.concat_ws(";", F.transform("q_points", lambda x: F.concat(x.cast("int").cast("string"), F.lit(".0")))).alias("qs"))


@query("a9_curves_to_points", f"{CURVES} SELECT model_id, unnest(qs) AS q, unnest(hs) AS h FROM curves")
def _(spark, d):
    return curve_ops.to_points(curves(spark, d), ["model_id"])


@query("a1_has_curve", f"{CURVES} SELECT len(qs) >= 3 AS has_curve, count(*) AS n FROM curves GROUP BY 1")
def _(spark, d):
    return curves(spark, d).groupBy(C.has_curve(F.col("q_points"), F.col("h_points")).alias("has_curve")).agg(F.count("*").alias("n"))


BEP = "list_min(list_transform(range(1, len(qs) + 1), lambda i: {'apart': abs(qs[i] - list_max(qs) * 0.65::DOUBLE), 'i': i})).i"


@query("a2_bep_point", f"{CURVES} SELECT model_id, qs[{BEP}] AS q_bep, hs[{BEP}] AS h_bep FROM curves")
def _(spark, d):
    return curves(spark, d).select("model_id", C.bep_point(F.col("q_points"), F.col("h_points")).alias("b")).select("model_id", F.col("b.q").alias("q_bep"), F.col("b.h").alias("h_bep"))


@query(
    "a3_interpolate",
    f"""{CURVES}, x AS (SELECT *, 20.5::DOUBLE AS t, list_filter(range(1, len(qs)), lambda i: 20.5::DOUBLE BETWEEN least(qs[i], qs[i + 1]) AND greatest(qs[i], qs[i + 1]))[1] AS a, list_min(list_transform(range(1, len(qs) + 1), lambda i: {{'apart': abs(qs[i] - 20.5::DOUBLE), 'i': i}})).i AS near FROM curves)
    SELECT model_id, CASE WHEN a IS NULL THEN hs[near] ELSE {up("hs[a] + (t - qs[a]) / (qs[a + 1] - qs[a]) * (hs[a + 1] - hs[a])", 2)} END AS h FROM x""",
)
def _(spark, d):
    return curves(spark, d).select("model_id", C.interpolate(F.col("q_points"), F.col("h_points"), F.lit(20.5)).alias("h"))


@query(
    "a4_curve_swap",
    f"""{CURVES}, x AS (SELECT model_id, CASE WHEN model_id % 3 = 0 THEN list_reverse(qs) ELSE qs END AS qs, CASE WHEN model_id % 3 = 0 THEN list_reverse(hs) ELSE hs END AS hs FROM curves),
    y AS (SELECT model_id, len(qs) - 1 AS n, len(list_filter(range(1, len(qs)), lambda i: qs[i + 1] < qs[i])) AS falls, len(list_filter(range(1, len(hs)), lambda i: hs[i + 1] > hs[i])) AS rises FROM x)
    SELECT model_id, n >= 2 AND falls > n * 0.6::DOUBLE AND rises > n * 0.6::DOUBLE AS swapped FROM y""",
)
def _(spark, d):
    turned = lambda x: F.when(F.col("model_id") % 3 == 0, F.reverse(x)).otherwise(F.col(x))
    return curves(spark, d).select("model_id", C.is_swapped(turned("q_points"), turned("h_points")).alias("swapped"))


@query("a5_fix_flow")
def _(spark, d):
    """Curves of which one flow is put out of order; a repair that sees its own steps has no plain SQL form."""
    bent = F.transform("q_points", lambda q, i: F.when(i == F.col("model_id") % 5 + 1, q - 7.0).otherwise(q))
    return curves(spark, d).select("model_id", bent.alias("bent")).withColumn("fixed", C.fix_flow(F.col("bent")))


@query("a6_scale_round", f"{CURVES} SELECT model_id, list_sum(list_transform(qs, lambda q: {up('q * 16.666666666666668::DOUBLE', 0)})) AS total FROM curves")
def _(spark, d):
    return curves(spark, d).select("model_id", F.aggregate(C.scale_round(F.col("q_points"), 16.666666666666668, 0), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("a7_zip_truncate", f"{CURVES} SELECT model_id, least(len(qs), 5) AS n FROM curves")
def _(spark, d):
    return curves(spark, d).select("model_id", F.size(C.zip_truncate(F.col("q_points"), F.slice("h_points", 1, 5))).cast("long").alias("n"))


@query(
    "a8_curve_checks",
    f"""{CURVES}, w AS (SELECT *, list_max(qs) * 0.2::DOUBLE AS s, list_filter(range(1, len(qs) + 1), lambda i: qs[i] > list_max(qs) * 0.2::DOUBLE) AS k FROM curves),
    v AS (SELECT *, list_transform(k, lambda i: hs[i]) AS wh FROM w)
    SELECT model_id, CASE WHEN len(qs) >= 3 THEN CASE WHEN len(wh) >= 3 AND len(list_filter(range(1, len(wh)), lambda i: wh[i + 1] > wh[i] * 1.05::DOUBLE)) > len(wh) * 0.4::DOUBLE THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS penalty FROM v""",
)
def _(spark, d):
    return curves(spark, d).select("model_id", physics.curve_penalty(F.col("q_points"), F.col("h_points")).alias("penalty"))


@query(
    "w10_curve_violations",
    f"""WITH {CURVE_POINTS}, l AS (SELECT *, lag(h) OVER (PARTITION BY model_id ORDER BY q) AS p FROM curve_points), c AS (SELECT *, count(*) OVER (PARTITION BY model_id) AS n, count(*) FILTER (h > p + 5) OVER (PARTITION BY model_id) AS v FROM l)
    SELECT model_id, q, h FROM c WHERE NOT (n >= 3 AND v > n // 10 AND coalesce(h > p + 10, false))""",
)
def _(spark, d):
    return curve_ops.drop_jumps(curve_points(spark, d), "model_id", share=10)


@query("w14_ascending_run", f"{CURVES} SELECT model_id, len(hs) >= 3 AND len(list_filter(range(1, len(hs)), lambda i: hs[i + 1] >= hs[i])) >= len(hs) * 0.7::DOUBLE AS ascending FROM curves")
def _(spark, d):
    return curves(spark, d).select("model_id", C.is_ascending(F.col("h_points")).alias("ascending"))


@query("j21_curve_nom_check", f"{CURVES} SELECT model_id, (model_id % 90) / list_max(qs) > 2.5::DOUBLE AS cleared FROM curves")
def _(spark, d):
    return curves(spark, d).select("model_id", ((F.col("model_id") % 90) / F.array_max("q_points") > 2.5).alias("cleared"))


@query(
    "q10_header_q0",
    f"""WITH {CURVE_POINTS}, z AS (SELECT model_id, CASE WHEN q < 10 THEN 0.0::DOUBLE ELSE q END AS q FROM curve_points), s AS (SELECT model_id, list(q ORDER BY q) AS qs FROM z GROUP BY model_id)
    SELECT model_id, coalesce(qs[1] = 0 AND qs[2] > 30 AND model_id % 10 <> 0, false) AS header FROM s""",
)
def _(spark, d):
    low = F.when(F.col("q") < 10, 0.0).otherwise(F.col("q"))
    qs = curve_points(spark, d).groupBy("model_id").agg(F.sort_array(F.collect_list(low)).alias("qs"))
    return qs.select("model_id", curve_ops.header_zero(F.col("qs"), F.col("model_id") % 10 == 0).alias("header"))


@query("q8_metadata_points", f"WITH {CURVE_POINTS} SELECT model_id, q, h FROM curve_points WHERE NOT (q IN (15, 20, 25, 32, 40, 50) AND h IN (30.0, 37.0, 45.0, 48.0, 75.0))")
def _(spark, d):
    return curve_points(spark, d).where(~curve_ops.is_metadata(F.col("q"), F.col("h"), [15, 20, 25, 32, 40, 50], [30.0, 37.0, 45.0, 48.0, 75.0])).select("model_id", "q", "h")


@query(
    "q9_valid_qh_pair",
    f"""WITH {CURVE_POINTS}, r AS (SELECT p_partkey AS model_id, p_size * 0.5::DOUBLE AS low, p_size * 1.5::DOUBLE AS high FROM part)
    SELECT model_id, q, h FROM curve_points JOIN r USING (model_id) WHERE q > 0 AND h > 0 AND h <= 400 AND q BETWEEN low AND high""",
)
def _(spark, d):
    from .inputs import table

    limits = table(spark, d, "part").select(F.col("p_partkey").alias("model_id"), (F.col("p_size") * 0.5).alias("low"), (F.col("p_size") * 1.5).alias("high"))
    return curve_ops.within_limits(curve_points(spark, d), limits, "model_id", h_max=400).select("model_id", "q", "h")


@query(
    "q7_garbage_points",
    f"""WITH {CURVE_POINTS} SELECT c.model_id, q, h FROM curve_points c JOIN part ON p_partkey = model_id WHERE substr(p_type, 1, 2) IN ('EC', 'PR', 'ST') AND q BETWEEN 0 AND 500 AND h > 0 AND h < 600""",
)
def _(spark, d):
    from .inputs import table

    valid = table(spark, d, "part").where(F.substring("p_type", 1, 2).isin("EC", "PR", "ST")).select(F.col("p_partkey").alias("model_id"))
    points = curve_points(spark, d).where(F.col("q").between(0, 500) & (F.col("h") > 0) & (F.col("h") < 600))
    return points.join(valid, "model_id", "left_semi")


@query("w4_score_merge", f"{CURVES}, s AS (SELECT model_id % 50 AS key, model_id, len(qs) AS n, hs[1] AS h FROM curves) SELECT key, model_id, n, h FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, model_id) AS r FROM s) WHERE r = 1")
def _(spark, d):
    s = curves(spark, d).select((F.col("model_id") % 50).alias("key"), "model_id", F.size("q_points").cast("long").alias("n"), F.get("h_points", F.lit(0)).alias("h"))
    best = s.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), "model_id", "h")).alias("b"))
    return best.select("key", "b.model_id", (-F.col("b.m")).alias("n"), "b.h")


@query("curve_steepest_step", f"WITH {CURVE_POINTS}, l AS (SELECT *, h - lag(h) OVER (PARTITION BY model_id ORDER BY q) AS step FROM curve_points) SELECT model_id, min(step) AS steepest FROM l GROUP BY model_id")
def _(spark, d):
    step = F.col("h") - F.lag("h").over(Window.partitionBy("model_id").orderBy("q"))
    return curve_points(spark, d).withColumn("step", step).groupBy("model_id").agg(F.min("step").alias("steepest"))
