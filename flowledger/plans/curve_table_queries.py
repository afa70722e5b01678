"""Queries over curve tables: tables and page texts made of the parts' values, and their DuckDB SQL, which reads them anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curve_tables as C
from .inputs import spread, table
from .registry import query

# a page for each part; '{...}' are the part's numbers
LINES = [
    "Overview  CDM 9-9  1.1  50  40  30",
    "CASE WHEN k % 4 = 0 THEN 'Q (m3/h)' WHEN k % 4 = 1 THEN 'Q (m3/h): 0 5 10 15' ELSE 'Q [m³/h]  0  5  10  15' END",
    "CASE WHEN k % 4 = 0 THEN '0  5  10,5  15' ELSE 'n = 2900 rpm' END",
    "concat('CDM ', n, '-', k % 20, '  ', CASE WHEN k % 7 = 0 THEN '0' ELSE '1,5' END, '  H (m)  ', n + 40, ',5  ', n + 30, '  ', n + 20, '.25  ', n + 5)",
    "H (m)  5",
    "concat('Model only ', n)",
    "concat('cdm ', n, '-', k % 20, '  2.2  9  8  7')",
    "CASE WHEN k % 3 = 0 THEN 'Q, l/min' ELSE 'Q l/min 10 20 30 40 50' END",
    "concat('PV(n) ', n, '-', k % 9, '  ', k % 600, '  ', n + 9, '  ', n + 8, '  ', n + 7, '  ', n + 6, '  ', n + 5, '  ', n + 4)",
    "concat('4,5  LVR ', k % 30, '  600  ', n + 3, '  ', n + 2)",
    "concat('XY  ', n + 3, '  ', n + 2, '  ', n + 1)",
]
TEXT = "concat_ws(chr(10), " + ", ".join(x if x.startswith(("CASE", "concat")) else f"'{x}'" for x in LINES) + ")"
CURVE_PAGES = f"curve_pages AS (SELECT k % 10 AS source_file, k AS page_num, {TEXT} AS text FROM (SELECT p_partkey AS k, p_size AS n FROM part))"

NUMBER_SQL = r"TRY_CAST(CASE WHEN regexp_full_match(replace(trim({0}), ',', '.'), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN replace(trim({0}), ',', '.') END AS DOUBLE)"
Q_SQL = r"'Q\s*[(\[]?\s*(?:м[³3]\s*/?\s*ч|m[³3]\s*/?\s*h|л/мин|l/min)', 'i'"
H_SQL = r"'^H\s*[(\[]?\s*(?:м|m)\s*[)\]]?', 'i'"
NOMINAL_SQL = "list_min(list_transform(range(1, len(qs) + 1), lambda i: {'apart': abs(qs[i] - list_max(qs) * 0.65::DOUBLE), 'i': i})).i"
ROUND_SQL = "floor({0} * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"
RESULT_SQL = f"""trim(model) AS model, regexp_replace(regexp_extract(model, '^([A-Za-z]{{2,}}(?:[\\s\\-]?[A-Za-z]+)?)', 1), '-+$', '') AS series, {ROUND_SQL.format('qs[k]')} AS q_nom, {ROUND_SQL.format('hs[k]')} AS h_nom, power_kw, rpm, len(qs) AS n,
  array_to_string(list_transform(qs, lambda x: CAST(CAST(x * 100 AS BIGINT) AS VARCHAR)), ';') AS q_points, array_to_string(list_transform(hs, lambda x: CAST(CAST(x * 100 AS BIGINT) AS VARCHAR)), ';') AS h_points, data_source, confidence"""

TEXT_SQL = f"""l0 AS (SELECT source_file, page_num, coalesce(TRY_CAST(regexp_extract(text, '([0-9]{{4}})\\s*(?:об/мин|rpm)', 1, 'i') AS INTEGER), 0) AS rpm, string_split(text, chr(10)) AS ls FROM curve_pages),
l1 AS (SELECT source_file, page_num, rpm, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line_no, trim(unnest(ls)) AS line FROM l0),
l2 AS (SELECT *, regexp_matches(line, {Q_SQL}) AS isq, list_transform(regexp_extract_all(line, '[0-9]+[.,]?[0-9]*'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS nums FROM l1),
l3 AS (SELECT *, lag(isq AND len(nums) < 3) OVER w AS given, lead(len(nums) >= 3) OVER w AS next_many FROM l2 WINDOW w AS (PARTITION BY source_file, page_num ORDER BY line_no)),
l4 AS (SELECT *, len(nums) >= 3 AND (isq OR coalesce(given, false)) AS flows FROM l3),
l5 AS (SELECT *, last_value(CASE WHEN flows THEN nums END IGNORE NULLS) OVER (PARTITION BY source_file, page_num ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS q, flows OR (isq AND len(nums) < 3 AND coalesce(next_many, false)) OR (regexp_matches(line, {H_SQL}) AND len(nums) < 3) OR line = '' AS skip FROM l4),
p0 AS (SELECT source_file, page_num, rpm, line_no, q, unnest(range(0, len(ps))) AS i, trim(unnest(ps)) AS part FROM (SELECT *, string_split_regex(line, '\\s{{2,}}') AS ps FROM l5 WHERE NOT skip AND q IS NOT NULL)),
p1 AS (SELECT *, {NUMBER_SQL.format('part')} AS x FROM p0 WHERE part <> ''),
p2 AS (SELECT *, x IS NULL AND NOT regexp_matches(part, {H_SQL}) AND length(part) >= 3 AS word FROM p1),
p3 AS (SELECT *, min(i) FILTER (word) OVER (PARTITION BY source_file, page_num, line_no) AS first_word FROM p2),
p4 AS (SELECT source_file, page_num, rpm, line_no, any_value(q) AS q, arg_max(part, i) FILTER (word) AS model, list(x ORDER BY i) FILTER (x IS NOT NULL AND i > first_word) AS v FROM p3 GROUP BY ALL),
p5 AS (SELECT *, CASE WHEN v[1] BETWEEN 0.03::DOUBLE AND 500 THEN v[1] ELSE 0.0::DOUBLE END AS power_kw, CASE WHEN v[1] BETWEEN 0.03::DOUBLE AND 500 THEN v[2:] ELSE v END AS hs0 FROM p4 WHERE model IS NOT NULL),
p6 AS (SELECT *, q[1:least(len(q), len(hs0))] AS qs, hs0[1:least(len(q), len(hs0))] AS hs FROM p5 WHERE len(hs0) >= 3),
by_text AS (SELECT source_file, page_num, line_no, {NOMINAL_SQL} AS k, model, rpm, power_kw, qs, hs, 'curve_table_text' AS data_source, 0.8::DOUBLE AS confidence FROM p6 WHERE len(hs) >= 3)"""


def pages(spark, d):
    spread(table(spark, d, "part").selectExpr("p_partkey AS k", "p_size AS n"), "k").createOrReplaceTempView("_curve_parts")
    return spark.sql(f"SELECT k % 10 AS source_file, k AS page_num, {TEXT} AS text FROM _curve_parts")


def as_text(found):
    points = lambda x: F.array_join(F.transform(x, lambda v: F.round(v * 100).cast("long").cast("string")), ";").alias(x)
    return found.select(*(points(c) if c.endswith("_points") else c for c in found.columns), F.size("q_points").cast("long").alias("n"))


@query("t19_curves_in_text", f"WITH {CURVE_PAGES}, {TEXT_SQL} SELECT source_file, page_num, line_no, {RESULT_SQL} FROM by_text")
def _(spark, d):
    return as_text(C.curves_in_text(pages(spark, d)))


# a table for each part: in the kinds 0 the flows are a row, in 1 the headers, in 2 nowhere, in 3 too far below; 4 is too short
ROWS = [
    "CASE WHEN kind = 0 THEN 'Q (м3/ч)||0|5|10,5' ELSE 'Pumps||a|b|c' END",
    "'H (m)||1|1|1'",
    "concat('CDM ', n, '-', k % 20, '|1,1|', n + 12, '|', n + 11, '|', n + 9, ',5')",
    "concat('|2,2|', n, '|8|7')",
    "concat('CDM ', n, '|none|-|', n + 8, '|7')",
    "concat('0,75|XY ', k % 50, '-3|', n + 9, '|8|0')",
    "CASE WHEN kind = 3 THEN 'Q (m3/h)||0|5|10' ELSE 'LVR 7|600|x|9|nan' END",
    "concat('cdm ', n, '-', k % 20, '|900|', n + 1, '|', n + 2, '|', n + 3)",
]
CURVE_TABLES = f"""parts AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 5 AS kind FROM part),
raw_rows AS (SELECT k AS table_id, kind, CASE WHEN kind = 4 THEN [{", ".join(ROWS[:2])}] ELSE [{", ".join(ROWS)}] END AS rs FROM parts),
raw_lines AS (SELECT table_id, CAST(unnest(range(0, len(rs))) AS INTEGER) AS row_id, string_split(unnest(rs), '|') AS cs FROM raw_rows),
raw_cells AS (SELECT table_id, row_id, CAST(unnest(range(0, len(cs))) AS INTEGER) AS col_id, unnest(cs) AS text FROM raw_lines),
raw_heads AS (SELECT table_id, string_split(CASE WHEN kind = 1 THEN 'Model, Q [m³/h]|kW|2|4|6' ELSE 'Model|kW|c|d|e' END, '|') AS cs FROM raw_rows)"""
TABLE_SQL = f"""sized AS (SELECT table_id FROM raw_lines GROUP BY 1 HAVING count(*) >= 3),
cand AS (SELECT table_id, row_id, row_id AS place, cs FROM raw_lines WHERE row_id < 5 UNION ALL SELECT table_id, -1, 5, cs FROM raw_heads),
cand2 AS (SELECT *, list_filter(list_transform(range(1, len(cs) + 1), lambda i: {{'i': i, 'x': {NUMBER_SQL.format('cs[i]')}}}), lambda z: z.x >= 0) AS qv FROM cand WHERE regexp_matches(array_to_string(cs, ' '), {Q_SQL})),
flow AS (SELECT table_id, arg_min(row_id, place) AS q_row, arg_min(qv, place) AS qv FROM cand2 WHERE len(qv) >= 3 GROUP BY 1),
m0 AS (SELECT r.table_id, r.row_id, cs, qv, qv[1].i AS s FROM raw_lines r JOIN flow USING (table_id) JOIN sized USING (table_id) WHERE r.row_id > q_row AND len(cs) >= qv[1].i + 1),
m1 AS (SELECT *, list_filter(list_transform(range(1, s), lambda i: {{'i': i, 't': trim(cs[i]), 'x': {NUMBER_SQL.format('cs[i]')}}}), lambda z: lower(z.t) NOT IN ('', 'none', 'nan', '-')) AS told FROM m0 WHERE NOT regexp_matches(trim(array_to_string(cs[1:s - 1], ' ')), {H_SQL})),
m2 AS (SELECT *, list_filter(told, lambda z: z.x IS NULL AND length(z.t) >= 3) AS words, list_filter(told, lambda z: z.x BETWEEN 0.03::DOUBLE AND 500) AS powers FROM m1),
m3 AS (SELECT *, list_filter(powers, lambda z: z.i > words[1].i) AS after, list_filter(list_transform(range(s, least(len(cs), s + len(qv) - 1) + 1), lambda i: {{'q': qv[i - s + 1].x, 'h': {NUMBER_SQL.format('cs[i]')}}}), lambda z: z.h > 0) AS p FROM m2 WHERE len(words) > 0),
by_table AS (SELECT *, {NOMINAL_SQL} AS k FROM (SELECT table_id, row_id, words[-1].t AS model, 0 AS rpm, coalesce(after[-1].x, powers[1].x, 0.0::DOUBLE) AS power_kw, list_transform(p, lambda z: z.q) AS qs, list_transform(p, lambda z: z.h) AS hs, 'curve_table' AS data_source, CASE WHEN len(p) >= 3 THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM m3 WHERE len(p) >= 2))"""


def tables(spark, d):
    """cells and headers of the tables."""
    spread(table(spark, d, "part").selectExpr("p_partkey AS k", "p_size AS n", "p_partkey % 5 AS kind"), "k").createOrReplaceTempView("_curve_parts")
    rows = spark.sql(f"SELECT k AS table_id, posexplode(CASE WHEN kind = 4 THEN array({', '.join(ROWS[:2])}) ELSE array({', '.join(ROWS)}) END) AS (row_id, row) FROM _curve_parts")
    heads = spark.sql("SELECT k AS table_id, CASE WHEN kind = 1 THEN 'Model, Q [m³/h]|kW|2|4|6' ELSE 'Model|kW|c|d|e' END AS row FROM _curve_parts")
    cut = F.posexplode(F.split("row", r"\|")).alias("col_id", "text")
    return rows.select("table_id", "row_id", cut), heads.select("table_id", cut)


@query("t19_curves_in_tables", f"WITH {CURVE_TABLES}, {TABLE_SQL} SELECT table_id, row_id, {RESULT_SQL} FROM by_table")
def _(spark, d):
    return as_text(C.curves_in_tables(*tables(spark, d)))


@query(
    "t19_curve_records",
    f"""WITH {CURVE_PAGES}, {TEXT_SQL}, {CURVE_TABLES}, {TABLE_SQL},
    both_forms AS (SELECT table_id % 10 AS source_file, table_id AS page_num, table_id AS place, CAST(row_id AS BIGINT) AS line_no, k, model, CASE WHEN table_id % 4 = 0 THEN 0 ELSE 2900 END AS rpm, power_kw, qs, hs, data_source, confidence FROM by_table
      UNION ALL SELECT source_file, page_num, -1, line_no, k, model, rpm, power_kw, qs, hs, data_source, confidence FROM by_text WHERE page_num NOT IN (SELECT table_id FROM by_table))
    SELECT source_file, page_num, place, line_no, {RESULT_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY source_file, page_num, upper(model) ORDER BY place, line_no) AS r FROM both_forms) WHERE r = 1""",
)
def _(spark, d):
    own = pages(spark, d)
    of = own.select(F.col("page_num").alias("table_id"), "source_file", "page_num")
    return as_text(C.curve_records(own, *tables(spark, d), of))
