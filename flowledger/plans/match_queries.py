"""Queries over coded names, names that are not quite equal, and lines of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import modelcodes as M
from ..functions import names
from ..operators import match
from ..operators import pages as P
from . import oracle as O
from .inputs import ENTRIES, PAGES, entries, pages, table
from .registry import query

FAMILIES = ["CDM ", "CV", "INL ", "TD", "PV(n) ", "FST ", "ZZ "]
HEAD_SQL = {f: "CASE p_size " + " ".join(f"WHEN {k} THEN {float(v)}::DOUBLE" for k, v in own.items()) + " END" for f, own in M.HEAD_OF_STAGE.items()}
FLOW_SQL = {f: "coalesce(CASE p_size " + " ".join(f"WHEN {k} THEN {float(v)}::DOUBLE" for k, v in own.items()) + " END, p_size * 0.5::DOUBLE)" for f, own in M.FLOW_OF_WIDTH.items()}
N = "(p_partkey % 20 + 1)"


@query(
    "f16_from_model_name",
    f"""SELECT p_partkey,
      CASE p_partkey % 7 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN 12.5::DOUBLE WHEN 3 THEN {FLOW_SQL["TG"]} WHEN 4 THEN p_size::DOUBLE WHEN 5 THEN {FLOW_SQL["FST"]} ELSE 0.0::DOUBLE END AS q,
      coalesce(CASE p_partkey % 7 WHEN 0 THEN floor({HEAD_SQL["CDM"]} * {N} * 10 + 0.5::DOUBLE) / 10 WHEN 1 THEN floor({HEAD_SQL["CV"]} * {N} * 10 + 0.5::DOUBLE) / 10 WHEN 2 THEN 18.0::DOUBLE WHEN 3 THEN {N}::DOUBLE END, 0.0::DOUBLE) AS h,
      CASE p_partkey % 7 WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN {N}::DOUBLE WHEN 5 THEN 7.5::DOUBLE ELSE 0.0::DOUBLE END AS p,
      CASE p_partkey % 7 WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 3000 ELSE 1500 END ELSE 0 END AS rpm FROM part""",
)
def _(spark, d):
    k, size, n = (F.col("p_partkey") % 7).cast("int"), F.col("p_size").cast("string"), (F.col("p_partkey") % 20 + 1).cast("string")
    inl = F.concat(F.lit("-12,5-18-"), n, F.when(F.col("p_size") % 2 == 0, "/2").otherwise("/4"))
    tail = F.when(k == 2, inl).when(k == 1, F.concat(F.lit("–"), n, F.lit("/1.5"))).when(k == 5, F.concat(F.lit("-"), n, F.lit("/75"))).otherwise(F.concat(F.lit("-"), n))
    name = F.concat(F.element_at(F.array(*map(F.lit, FAMILIES)), k + 1), size, tail)
    none = F.lit(0.0)
    return table(spark, d, "part").select("p_partkey", M.from_model_name(name, none, none, none, F.lit(0)).alias("m")).select("p_partkey", "m.*")


@query("f17_affinity_head", "WITH f AS (SELECT p_partkey, p_size, floor((p_size * 5 / 200.0::DOUBLE) * (p_size * 5 / 200.0::DOUBLE) * 32.0::DOUBLE * 10 + 0.5::DOUBLE) / 10 AS h FROM part) SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN floor(h * 0.25::DOUBLE * 10 + 0.5::DOUBLE) / 10 ELSE h END AS h FROM f")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", M.affinity_head(F.col("p_size") * 5, F.when(F.col("p_size") % 3 == 0, 1450).when(F.col("p_size") % 3 == 1, 960).otherwise(2900)).alias("h"))


@query("f23_clean_raw_name", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('AB ', p_size::varchar, '-1') WHEN 1 THEN concat('CDM', p_size::varchar, '-2') WHEN 5 THEN concat('CD ', p_size::varchar) END AS name FROM part")
def _(spark, d):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("Трёхфазный AB "), size, F.lit("-1"))).when(k == 1, F.concat(F.lit("CDM"), size, F.lit("-2 CDM"), size, F.lit("-3"))).when(k == 2, F.concat(F.lit("YE3-"), size))
        .when(k == 3, F.concat(size, F.lit("-1.5 2"))).when(k == 4, "AB").otherwise(F.concat(F.lit("single-phase CD "), size))
    )
    return table(spark, d, "part").select("p_partkey", M.clean_raw_name(raw).alias("name"))


@query("f9_clean_model", "SELECT p_partkey, concat('CBM', p_size::varchar) AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", names.clean_name(F.concat(F.lit(" СВМ"), F.col("p_size").cast("string"), F.lit("**"))).alias("name"))


@query("f22_prepend_series", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('EC ', p_size::varchar, '-1') ELSE concat('X', p_size::varchar) END AS name FROM part")
def _(spark, d):
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", names.prepend_series(F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit("-1"))).otherwise(F.concat(F.lit("X"), size)), F.lit("EC")).alias("name"))


@query("q11_overview_filter", "SELECT p_partkey FROM part WHERE NOT (p_partkey % 3 = 0 AND NOT p_size > 25 AND NOT (p_size > 10 AND p_retailprice > 1000))")
def _(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("CV "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("CV "), F.col("p_size").cast("string"), F.lit("-1")))
    over = M.is_overview(name, F.greatest(F.col("p_size") - 25, F.lit(0)), F.greatest(F.col("p_size") - 10, F.lit(0)), F.greatest(F.col("p_retailprice") - 1000, F.lit(0.0)))
    return table(spark, d, "part").where(~over).select("p_partkey")


# ---------------------------------------------------------------- joins of names

SIDES = f"k AS (SELECT {O.key()} AS key, data_source, min(seq) AS place FROM entries GROUP BY ALL), rt AS (SELECT concat(CASE WHEN place % 2 = 0 THEN 'F' ELSE '' END, CASE WHEN place % 3 = 0 THEN substr(key, 2) ELSE key END) AS key, place FROM k WHERE data_source = 'estimated'), lf AS (SELECT DISTINCT key FROM k WHERE data_source = 'catalog_curve')"


def sides(spark, d):
    """Keys of curve records, and those of estimated records with other letters before their digits."""
    k = entries(spark, d).groupBy(names.model_key(F.col("model")).alias("key"), "data_source").agg(F.min("seq").alias("place"))
    altered = F.concat(F.when(F.col("place") % 2 == 0, "F").otherwise(""), F.when(F.col("place") % 3 == 0, F.expr("substr(key, 2)")).otherwise(F.col("key")))
    return k.where("data_source = 'catalog_curve'").select("key").distinct(), k.where("data_source = 'estimated'").select(altered.alias("key"), "place")


@query(
    "j7_numeric_part_join",
    f"""WITH {ENTRIES}, {SIDES}, a AS (SELECT key, regexp_extract(key, '^([A-Z]+)(\\d.*)$', 1) AS l, regexp_extract(key, '^([A-Z]+)(\\d.*)$', 2) AS n FROM lf), b AS (SELECT key AS other, place, regexp_extract(key, '^([A-Z]+)(\\d.*)$', 1) AS l, regexp_extract(key, '^([A-Z]+)(\\d.*)$', 2) AS n FROM rt)
    SELECT key, arg_min(other, {{'p': place, 'o': other}}) AS other FROM a JOIN b ON a.n = b.n AND a.n <> '' AND (starts_with(a.l, b.l) OR starts_with(b.l, a.l)) GROUP BY key""",
)
def _(spark, d):
    return match.numeric_part_join(*sides(spark, d))


@query(
    "j8_fuzzy_match",
    f"""WITH {ENTRIES}, {SIDES}, v AS (SELECT key, unnest([key, regexp_replace(key, '^([A-Z]+?)(\\d.*)$', '\\1F\\2'), regexp_replace(key, '^([A-Z]*?)F(\\d.*)$', '\\1\\2')]) AS kv FROM lf),
    eq AS (SELECT DISTINCT key, key AS other FROM lf WHERE key IN (SELECT key FROM rt)),
    fz AS (SELECT v.key, arg_min(rt.key, {{'p': place, 'o': rt.key}}) AS other FROM v JOIN rt ON rt.key <> '' AND (starts_with(rt.key, kv) OR starts_with(kv, rt.key)) WHERE v.key NOT IN (SELECT key FROM eq) GROUP BY v.key)
    SELECT * FROM eq UNION ALL SELECT * FROM fz""",
)
def _(spark, d):
    return match.fuzzy_match(*sides(spark, d))


@query(
    "j4_variant_fill",
    """WITH l AS (SELECT p_partkey % 300 AS id, concat('CMI', (p_partkey % 300)::varchar, CASE WHEN p_size % 2 = 0 THEN 'T-BQCE' ELSE '' END) AS key, max(CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE ELSE 0.0::DOUBLE END) AS h FROM part GROUP BY ALL),
    r AS (SELECT key, max(id::DOUBLE) AS h FROM l WHERE id % 5 = 1 GROUP BY key), s AS (SELECT regexp_replace(key, 'T?-?BQCE$', '') AS base, max(h) AS h FROM l WHERE h > 0 GROUP BY 1)
    SELECT l.id, l.key, CASE WHEN l.h > 0 THEN l.h ELSE coalesce(r.h, s.h, l.h) END AS h, CASE WHEN l.h > 0 THEN NULL WHEN r.h IS NOT NULL THEN 0.5::DOUBLE WHEN s.h IS NOT NULL THEN 0.4::DOUBLE END AS h_confidence,
      CASE WHEN l.h > 0 THEN NULL WHEN r.h IS NOT NULL THEN 'exact' WHEN s.h IS NOT NULL THEN 'variant' END AS h_source FROM l LEFT JOIN r ON r.key = l.key AND r.h > 0 LEFT JOIN s ON s.base = regexp_replace(l.key, 'T?-?BQCE$', '')""",
)
def _(spark, d):
    key = F.concat(F.lit("CMI"), (F.col("p_partkey") % 300).cast("string"), F.when(F.col("p_size") % 2 == 0, "T-BQCE").otherwise(""))
    left = table(spark, d, "part").groupBy((F.col("p_partkey") % 300).alias("id"), key.alias("key")).agg(F.max(F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")).otherwise(0.0)).alias("h"))
    right = left.where("id % 5 = 1").select("key", F.col("id").cast("double").alias("h"))
    return match.variant_fill(left, right).select("id", "key", "h", "h_confidence", "h_source")


NUMBERS_SQL = "list_distinct(list_transform(regexp_extract_all(text, '[0-9]+[.,]?[0-9]*'), lambda n: TRY_CAST(replace(n, ',', '.') AS DOUBLE)))"


@query(
    "j15_ocr_verify",
    f"""WITH {PAGES}, x AS (SELECT page_num, text, CAST(page_num % 40 AS DOUBLE) AS v, (page_num % 10) / 10 AS c, contains(regexp_replace(upper(text), '[\\s\\-]', '', 'g'), 'THE') AND page_num % 40 > 0 AS named, list_filter({NUMBERS_SQL}, lambda n: n >= 0.1::DOUBLE AND n <= 1000) AS ns FROM pages_in),
    y AS (SELECT *, named AND len(list_filter(ns, lambda n: n > 0 AND abs(n - v) / greatest(n, v) <= 0.05::DOUBLE)) > 0 AS yes, list_min(list_transform(ns, lambda n: {{'a': abs(n - v), 'n': n}})).n AS near FROM x)
    SELECT page_num, CASE WHEN yes THEN v WHEN named AND c <= 0.5 AND near > 0 THEN near ELSE v END AS value, CASE WHEN yes THEN least(1.0::DOUBLE, c + 0.3::DOUBLE) WHEN named AND c <= 0.5 AND near > 0 THEN 0.7::DOUBLE ELSE c END AS confidence,
      CASE WHEN yes THEN 'confirmed' WHEN named AND c <= 0.5 AND near > 0 THEN 'ocr' ELSE 'unchanged' END AS source FROM y""",
)
def _(spark, d):
    value, sure = (F.col("page_num") % 40).cast("double"), F.col("page_num") % 10 / 10
    # fixed values: flows from 0.1 to 1000 are reasonable
    return pages(spark, d).select("page_num", match.ocr_verified(F.col("text"), F.lit("t-he"), value, sure, 0.1, 1000.0).alias("r")).select("page_num", "r.*")


@query(
    "j16_text_confirm",
    f"""WITH {PAGES}, x AS (SELECT page_num, contains(lower(text), 'the') OR contains(lower(text), 'und') AS named, page_num % 7 <> 0 AND (list_contains(list_transform(regexp_extract_all(text, '\\d+[.,]\\d+|\\d+'), lambda n: replace(n, ',', '.')), ((page_num % 7) / 2.0::DOUBLE)::varchar) OR contains(text, replace(((page_num % 7) / 2.0::DOUBLE)::varchar, '.', ','))) AS found FROM pages_in)
    SELECT page_num, CASE WHEN named AND found THEN 0.75::DOUBLE WHEN named OR found THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END AS confidence FROM x""",
)
def _(spark, d):
    return pages(spark, d).select("page_num", match.text_confidence(F.col("text"), F.lit("The-und/32"), [F.col("page_num") % 7 / 2.0]).alias("confidence"))


# ---------------------------------------------------------------- lines


@query("p29_find_q_values", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 3 END AS line_no, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 3 END AS n, CASE WHEN p_size % 3 = 0 THEN p_size + 7.5::DOUBLE ELSE p_size + 30.5::DOUBLE END AS total FROM part WHERE p_size % 5 <> 4")
def _(spark, d):
    size = F.col("p_size").cast("string")
    first = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("row 7,5 "), size, F.lit(" 900"))).otherwise("row 7,5 x")
    second = F.concat(F.lit("10 20,5 "), size, F.lit(" 501"))
    text = F.concat_ws("\n", F.lit("Модель 1 2 3"), first, F.lit("кВт 5 6"), second)
    text = F.when(F.col("p_size") % 5 == 4, "a 1\nb 2\nc").otherwise(text)
    return P.q_values(table(spark, d, "part").select("p_partkey", text.alias("text"))).select("p_partkey", "line_no", F.size("q").alias("n"), F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("p28_line_points", "SELECT p_partkey, concat(p_size::varchar, '-2') AS id, 2.2::DOUBLE AS kw, (i - 1) * 10.0::DOUBLE AS q, p_size + 5.0::DOUBLE - i AS h FROM part, (SELECT unnest([1, 2, 3]) AS i) WHERE p_partkey % 4 <> 3")
def _(spark, d):
    s = F.col("p_size")
    heads = F.concat_ws(" ", *(F.concat((s + 5 - i).cast("string"), F.lit(",0")) for i in (1, 2, 3)), F.lit("700 9"))
    line = F.when(F.col("p_partkey") % 4 == 3, "no id here").otherwise(F.concat(s.cast("string"), F.lit("−2  2,2 "), heads))
    return P.line_points(table(spark, d, "part").select("p_partkey", line.alias("line"), F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0)).alias("q")), "line", "q").select("p_partkey", "id", "kw", "q", "h")


@query("p10_list_records", "SELECT p_partkey, concat('TD', p_size::varchar, '-14G/2') AS model, 8.0::DOUBLE AS q, 14.5::DOUBLE AS h, CASE WHEN p_partkey % 2 = 0 THEN 2900 ELSE 0 END AS rpm, CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END AS p FROM part WHERE p_partkey % 5 <> 4")
def _(spark, d):
    size = F.col("p_size").cast("string")
    speed, power = F.when(F.col("p_partkey") % 2 == 0, " 2900").otherwise(""), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(" 0,75")
    text = F.concat(F.lit("intro\nTD"), size, F.lit("-14G/2 8 "), F.when(F.col("p_partkey") % 5 == 4, "1400").otherwise("14,5"), speed, power, F.lit("\nend"))
    return P.list_records(table(spark, d, "part").select("p_partkey", text.alias("text"))).select("p_partkey", "model", "q", "h", "rpm", "p")
