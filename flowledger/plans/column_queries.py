"""Column roles, direct mapping and hidden header records over tables made of the parts, a kind of headers for each guard."""

from __future__ import annotations

from ..operators import columns as C
from .inputs import table
from .registry import query

# headers by kind; kinds 12 and on have rows with gaps
HEADS = [
    "Model|Q, m³/h|H, m|Power kW|rpm|Hp", "Model|A|B.|L1|H|Q", "Model|A|H|Q", "Type|Power kW / head|Head m|n, 1/min", "Model|Q 10|q 20|Flow 30|capacity|H, m|kW", "Model|26 100 6|40 150.9|60.3|20.1.2.h=total|kW",
    "Pump type|l/h 5|x m/h 0 h|GPM 0.l/min0 m/h 0.", "Размеры [мм]|Q|H", "Модель|Габаритные размеры|Напор|Подача", "Model|Size|Q|Flow, q", "Model|л.с.|kW, hp|скорость|H=", "Model|H (mm)|Head, m|Q|Мощн P2 H,",
    "Model|Q m3/h.12.H=Total|26 100 6|40 150.9|60.3.1|Head total m|HP", "Type|Flow|Head A|Head B|kW|Hp", "Model|H, m|Capacity", "Модель|H [мм]|Q|kW", "Model.Model.TD{n}-14G/2|H [m].H [m].14|Q.8|HP.3", "Model|50.3|75.4.5|100.6.H=x|120.7|h",
]
CELLS = {
    12: ["CDM {n}-1||-|7,5|{n}|-|3", "CDM {n}-2|5|12|0,2|9||-", "XY|1|2|3|4|5|6"], 13: ["FST {n}-160|1,5|-|{n}|kw 2.2|4", "FST {n}-200|{n}|9|8||3", "FST {n}-250|||||"],
    14: ["CV {n}-10|kw 3.5|{n}", "CV {n}-11|{n}|"], 15: ["CV {n}-11|{n}|3|1,1", "CV {n}-12|7||"], 16: ["TL {n}-1|4|{n}|2", "TL {n}-2|||"], 17: ["LVR {n}-3|1|2|3|4|", "LVR {n}-4|0,1|-|31|4|5"],
}
fill = lambda text: " || ".join(f"'{p}'" if i % 2 == 0 else "n" for i, p in enumerate(text.replace("{n}", "\0n\0").split("\0")))
by_kind = lambda values, of: "CASE kind " + " ".join(f"WHEN {k} THEN {of(v)}" for k, v in values) + " END"
HEAD_ROW = by_kind(enumerate(HEADS), fill)
ROWS = by_kind(CELLS.items(), lambda rows: "{0}(" + ", ".join(map(fill, rows)) + ")")
PARTS = "p AS (SELECT p_partkey AS table_id, CAST(p_partkey % 18 AS INTEGER) AS kind, CAST(p_size AS VARCHAR) AS n FROM part)"
TABLES = f"""{PARTS}, hr AS (SELECT table_id, string_split({HEAD_ROW}, '|') AS hs FROM p), heads AS (SELECT table_id, CAST(unnest(range(0, len(hs))) AS INTEGER) AS col_id, unnest(hs) AS text FROM hr),
rr AS (SELECT table_id, {ROWS.format('list_value')} AS rs FROM p WHERE kind >= 12), rl AS (SELECT table_id, CAST(unnest(range(0, len(rs))) AS INTEGER) AS row_id, string_split(unnest(rs), '|') AS cs FROM rr)"""


def words(values: list[str], text: str = "s") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in values) + ")"


codes = ", ".join(f"'{c}'" for c in C.DIMENSION_CODES)
BARE = r"regexp_replace(regexp_replace(s, 'gpm|min|l|m|h', '', 'g'), '[/\s.×,]', '', 'g')"
ROLES_SQL = f"""f0 AS (SELECT *, lower(trim(text)) AS s FROM heads),
f1 AS (SELECT *, {words(C.FLOW_WORDS)} AS fw, length(s) >= 3 AND (regexp_full_match({BARE}, '[0-9]+') OR regexp_matches(s, '^\\d+[.\\d]*\\.(?:h=|head|напор)') OR regexp_matches(s, '^q[=\\s]')) AS fp, rtrim(s, '.') IN ({codes}) AS dim, {words(C.POWER_WORDS)} AS kw, {words(C.MODEL_WORDS)} AS m, {words(C.SPEED_WORDS)} AS r, {words(C.HORSE_WORDS)} AS hp,
  {words(C.HEAD_WORDS)} OR (instr(s, 'h ') > 0 AND (instr(s, 'h ') = 1 OR substr(s, instr(s, 'h ') - 1, 1) <> '/')) AS hw, {words(C.DIMENSION_WORDS)} AS dw, {words(C.PUMP_WORDS)} AS pw FROM f0),
f2 AS (SELECT *, count(*) FILTER (fw) OVER t >= 4 OR count(*) FILTER (fp) OVER t >= 4 AS grid, bool_or(dw) OVER t AND NOT bool_or(pw) OVER t AS none, (hw OR (s = 'h' AND count(*) FILTER (dim) OVER t < 3)) AND NOT kw AS h FROM f1 WINDOW t AS (PARTITION BY table_id)),
r1 AS (SELECT *, min(col_id) FILTER (m AND NOT none) OVER (PARTITION BY table_id) AS model_col FROM f2),
r2 AS (SELECT *, min(col_id) FILTER (fw AND NOT h AND NOT grid AND NOT none AND col_id IS DISTINCT FROM model_col) OVER (PARTITION BY table_id) AS q_col FROM r1),
r3 AS (SELECT *, min(col_id) FILTER (h AND NOT none AND col_id IS DISTINCT FROM model_col AND col_id IS DISTINCT FROM q_col) OVER (PARTITION BY table_id) AS h_col FROM r2),
r4 AS (SELECT *, min(col_id) FILTER (kw AND NOT none AND col_id IS DISTINCT FROM model_col AND col_id IS DISTINCT FROM q_col AND col_id IS DISTINCT FROM h_col) OVER (PARTITION BY table_id) AS kw_col FROM r3),
r5 AS (SELECT *, min(col_id) FILTER (r AND NOT none AND col_id IS DISTINCT FROM model_col AND col_id IS DISTINCT FROM q_col AND col_id IS DISTINCT FROM h_col AND col_id IS DISTINCT FROM kw_col) OVER (PARTITION BY table_id) AS rpm_col FROM r4),
roles AS (SELECT table_id, any_value(model_col) AS model_col, any_value(q_col) AS q_col, any_value(h_col) AS h_col, any_value(kw_col) AS kw_col, any_value(rpm_col) AS rpm_col,
  min(col_id) FILTER (hp AND NOT none AND col_id IS DISTINCT FROM model_col AND col_id IS DISTINCT FROM q_col AND col_id IS DISTINCT FROM h_col AND col_id IS DISTINCT FROM kw_col AND col_id IS DISTINCT FROM rpm_col) AS hp_col, bool_or(grid) AS grid,
  coalesce(bool_or({words(C.MILLIMETRES)}) FILTER (col_id = h_col), false) AS h_in_mm, list(text ORDER BY col_id) AS hs FROM r5 GROUP BY table_id)"""

NUM = r"TRY_CAST(CASE WHEN regexp_full_match(replace(trim({0}), ',', '.'), '\d+(\.\d+)?') THEN replace(trim({0}), ',', '.') END AS DOUBLE)"
KW = r"CASE WHEN regexp_matches(lower({0}), 'kw\s+[\d.,]+') THEN CAST(replace(regexp_extract(lower({0}), 'kw\s+([\d.,]+)', 1), ',', '.') AS DOUBLE) ELSE {1} END"
FIRST = "list_filter(list_transform(list_filter(range(1, len(hs) + 1), lambda i: NOT list_contains(skip, i - 1)), lambda i: {0}), lambda v: {1})[1]"
LOW = "lower(trim(hs[i]))"
TOLD = rf"coalesce(TRY_CAST(nullif(regexp_extract({LOW}, 'm.?/h[)\s.]*(\d+[.,]?\d*)', 1), '') AS DOUBLE), floor(TRY_CAST(nullif(regexp_extract({LOW}, 'l/min[)\s.]*(\d+[.,]?\d*)', 1), '') AS DOUBLE) / 16.67::DOUBLE * 10 + 0.5::DOUBLE) / 10, TRY_CAST(nullif(regexp_extract({LOW}, '(?:q|flow|delivery|capacity)[^0-9]*(\d+[.,]?\d*)', 1), '') AS DOUBLE))"
PAIR = r"CASE WHEN TRY_CAST(nullif(regexp_extract(hs[i], '^(\d+)[.](\d+[.]?\d*)[.]?(?:H=|$)', 2), '') AS DOUBLE) < TRY_CAST(nullif(regexp_extract(hs[i], '^(\d+)[.]', 1), '') AS DOUBLE) THEN TRY_CAST(nullif(regexp_extract(hs[i], '^(\d+)[.](\d+[.]?\d*)[.]?(?:H=|$)', 2), '') AS DOUBLE) END"
ROUND = "floor({0} * 100 + 0.5::DOUBLE) / 100"
ROWS_SQL = f"""w0 AS (SELECT table_id, row_id, cs, roles.* EXCLUDE (table_id), list_filter([model_col, q_col, kw_col, rpm_col, hp_col], lambda x: x IS NOT NULL) AS skip FROM rl JOIN roles USING (table_id) WHERE model_col IS NOT NULL AND coalesce(q_col, h_col, kw_col) IS NOT NULL AND length(trim(cs[model_col + 1])) >= 3),
w1 AS (SELECT *, {NUM.format('cs[q_col + 1]')} AS q0, {NUM.format('cs[h_col + 1]')} AS h0, {KW.format('cs[kw_col + 1]', NUM.format('cs[kw_col + 1]'))} AS kw0, {NUM.format('cs[hp_col + 1]')} AS hp0, {KW.format('cs[h_col + 1]', NUM.format('cs[h_col + 1]'))} AS kwh,
  CASE WHEN grid THEN coalesce({FIRST.format(TOLD, 'v > 0 AND v < 500')}, {FIRST.format(PAIR, 'v > 0.1::DOUBLE AND v < 200')}) END AS qg,
  {FIRST.format(f"CASE WHEN {words(C.OTHER_HEAD_WORDS, 'lower(hs[i])')} THEN {NUM.format('cs[i]')} END", 'v > 0')} AS hw,
  CASE WHEN grid THEN {FIRST.format(f"CASE WHEN length(hs[i]) >= 3 AND regexp_full_match({BARE.replace('(s,', f'({LOW},')}, '[0-9]+') THEN {NUM.format('cs[i]')} END", 'v > 0.5::DOUBLE AND v < 300')} END AS hg FROM w0),
by_row AS (SELECT table_id, row_id, trim(cs[model_col + 1]) AS model, coalesce(nullif(q0, 0), qg) AS q, coalesce(nullif(h0, 0), hw, hg) AS h, coalesce(nullif(kw0, 0), {ROUND.format('nullif(hp0, 0) * 0.7457::DOUBLE')}, nullif(kwh, 0)) AS kw, CAST({NUM.format('cs[rpm_col + 1]')} AS INTEGER) AS rpm, CASE WHEN h_in_mm THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS confidence_h FROM w1)"""
LAST = "list_filter(list_transform(list_reverse(string_split(hs[{0} + 1], '.')), lambda p: {1}), lambda v: v > 0)[1]"
HIDDEN_SQL = f"""hidden AS (SELECT table_id, -1 AS row_id, list_filter(list_transform(list_reverse(string_split(hs[model_col + 1], '.')), lambda p: trim(p)), lambda p: regexp_matches(p, '^TD\\d+'))[1] AS model, {LAST.format('q_col', NUM.format('p'))} AS q, {LAST.format('h_col', NUM.format('p'))} AS h,
  coalesce({LAST.format('kw_col', NUM.format('p'))}, {ROUND.format(LAST.format('hp_col', NUM.format('p')) + ' * 0.7457::DOUBLE')}) AS kw, NULL::INTEGER AS rpm, 0.6::DOUBLE AS confidence_h FROM roles WHERE model_col IS NOT NULL AND h_col IS NOT NULL)"""


def tables(spark, d):
    """cells and headers."""
    table(spark, d, "part").createOrReplaceTempView("part")
    parts = PARTS.replace("AS VARCHAR", "AS STRING")
    heads = spark.sql(f"WITH {parts} SELECT table_id, posexplode(split({HEAD_ROW}, '[|]')) AS (col_id, text) FROM p")
    rows = spark.sql(f"WITH {parts}, r AS (SELECT table_id, posexplode({ROWS.format('array')}) AS (row_id, line) FROM p WHERE kind >= 12) SELECT table_id, row_id, posexplode(split(line, '[|]')) AS (col_id, text) FROM r")
    return rows, heads


@query("t21_identify_columns", f"WITH {TABLES}, {ROLES_SQL} SELECT table_id, model_col, q_col, h_col, kw_col, rpm_col, hp_col, grid, h_in_mm FROM roles")
def _(spark, d):
    return C.column_roles(tables(spark, d)[1]).drop("names")


@query("t22_row_records", f"WITH {TABLES}, {ROLES_SQL}, {ROWS_SQL} SELECT * FROM by_row")
def _(spark, d):
    cells, heads = tables(spark, d)
    return C.row_records(cells, C.column_roles(heads))


@query("t23_header_records", f"WITH {TABLES}, {ROLES_SQL}, {HIDDEN_SQL} SELECT * FROM hidden WHERE model IS NOT NULL")
def _(spark, d):
    return C.header_records(C.column_roles(tables(spark, d)[1]))


@query(
    "t22_direct_records",
    f"""WITH {TABLES}, {ROLES_SQL}, {ROWS_SQL}, {HIDDEN_SQL}, found AS (SELECT *, replace(upper(model), ' ', '') AS key FROM (SELECT * FROM by_row UNION ALL SELECT * FROM hidden WHERE model IS NOT NULL)),
    pick AS (SELECT key, arg_min(model, {{'t': table_id, 'r': row_id}}) AS model, arg_min(q, {{'t': table_id, 'r': row_id}}) FILTER (q IS NOT NULL) AS q, arg_min(h, {{'c': -confidence_h, 't': table_id, 'r': row_id}}) FILTER (h IS NOT NULL) AS h, arg_min(kw, {{'t': table_id, 'r': row_id}}) FILTER (kw IS NOT NULL) AS kw, max(confidence_h) FILTER (h IS NOT NULL) AS c, min({{'t': table_id, 'r': row_id}}) AS spot FROM found GROUP BY key)
    SELECT key, model, coalesce(q, 0) AS q, coalesce(h, 0) AS h, coalesce(kw, 0) AS kw, coalesce(c, 0) AS confidence_h, spot.t AS table_id, spot.r AS row_id FROM pick""",
)
def _(spark, d):
    return C.direct_records(*tables(spark, d))
