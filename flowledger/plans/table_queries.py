"""Queries over raw table cells and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.units import detect_unit, unit_in
from ..operators import tables as T
from .inputs import CELLS, ENTRIES, cells, entries, spread, table, tasks_for
from .registry import query

HEADS = ["Model", "Flow (m3/h)", "Head, m", "Power P2 [kW]", "Drehzahl rpm", "H1", "zzz"]


def headers(spark, d):
    """Seven headers for each supplier's table."""
    s = spread(table(spark, d, "supplier").select(F.col("s_suppkey").alias("table_id")), "table_id")
    return s.select("table_id", F.posexplode(F.array(*map(F.lit, HEADS))).alias("col_id", "text"))


HEADERS = f"headers AS (SELECT s_suppkey AS table_id, CAST(i AS INTEGER) AS col_id, {HEADS}[i + 1] AS text FROM supplier, (SELECT unnest(range(0, 7)) AS i))"


@query("f1_parse_number", f"WITH {CELLS} SELECT table_id, row_id, col_id, TRY_CAST(replace(text, ',', '.') AS DOUBLE) AS x FROM cells")
def _(spark, d):
    return cells(spark, d).select("table_id", "row_id", "col_id", N.parse_number(F.col("text")).alias("x"))


@query("f2_parse_number_rich", f"WITH {CELLS} SELECT table_id, row_id, col_id, TRY_CAST(replace(text, ',', '.') AS DOUBLE) AS plain, TRY_CAST(replace(text, ',', '.') AS DOUBLE) AS marked, TRY_CAST(replace(text, ',', '.') AS DOUBLE) AS first_of_range FROM cells")
def _(spark, d):
    t = F.col("text")
    return cells(spark, d).select("table_id", "row_id", "col_id", N.parse_number_rich(t).alias("plain"), N.parse_number_rich(F.concat(F.lit("~ "), t, F.lit(" м³/ч"))).alias("marked"), N.parse_number_rich(F.concat(t, F.lit("-99"))).alias("first_of_range"))


@query("f3_parse_broken_number", f"WITH {CELLS} SELECT table_id, row_id, col_id, CAST(replace(text, ',', '.') AS DOUBLE) AS x FROM cells")
def _(spark, d):
    torn = F.regexp_replace(F.regexp_replace("text", ",", " ,"), r"^(\d)(\d)", "$1 $2")
    return cells(spark, d).select("table_id", "row_id", "col_id", N.parse_broken_number(F.regexp_replace(torn, r"\s+,", ",")).alias("x"))


@query("f4_parse_slash_number", f"WITH {CELLS} SELECT table_id, row_id, col_id, CASE WHEN col_id % 2 = 0 THEN 2.2::DOUBLE ELSE CAST(replace(text, ',', '.') AS DOUBLE) END AS x FROM cells")
def _(spark, d):
    text = F.when(F.col("col_id") % 2 == 0, F.concat("text", F.lit(" / 2,2"))).otherwise(F.concat("text", F.lit(" / --")))
    return cells(spark, d).select("table_id", "row_id", "col_id", N.parse_slash_number(text).alias("x"))


@query("f5_parse_range", f"WITH {CELLS}, x AS (SELECT *, CAST(replace(text, ',', '.') AS DOUBLE) AS v FROM cells) SELECT table_id, row_id, col_id, least(v, 20.0::DOUBLE) AS low, greatest(v, 20.0::DOUBLE) AS high, (least(v, 20.0::DOUBLE) + greatest(v, 20.0::DOUBLE)) / 2 AS mid FROM x")
def _(spark, d):
    text = F.concat("text", F.lit(" - 20 m³/h"))
    return cells(spark, d).select("table_id", "row_id", "col_id", N.parse_range(text).alias("r"), N.range_mid(text).alias("mid")).select("table_id", "row_id", "col_id", "r.low", "r.high", "mid")


@query("cells", f"WITH {CELLS} SELECT * FROM cells")
def _(spark, d):
    return cells(spark, d)


FIELDS = "CASE col_id WHEN 0 THEN 'model' WHEN 1 THEN 'q_nom' WHEN 2 THEN 'h_nom' WHEN 3 THEN 'power_kw' WHEN 4 THEN 'rpm' WHEN 5 THEN 'h_nom' END"


@query("t1_match_headers", f"WITH {HEADERS} SELECT table_id, col_id, {FIELDS} AS field, CASE col_id WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 8 WHEN 5 THEN 5 END AS score FROM headers WHERE col_id < 6")
def _(spark, d):
    return headers(spark, d).select("table_id", "col_id", T.header_field(F.col("text")).alias("f")).where("f IS NOT NULL").select("table_id", "col_id", "f.field", "f.score")


# the words of each field, written out again: field, place of the field, words
WORDS_SQL = """kw AS (SELECT f, i, unnest(string_split(ws, '|')) AS w FROM (VALUES
('model', 0, 'модель|тип|насос|наименование|обозначение|марка|model|type|pump|designation|name|item|modell|typ|pumpe|bezeichnung|baureihe|modello|tipo|pompa|denominazione|modèle|pompe|désignation|modelo|bomba|denominación'),
('q_nom', 1, 'подача|расход|производительность|объёмная подача|flow|capacity|delivery|discharge|flow rate|förderstrom|fördermenge|volumenstrom|durchfluss|portata|portata nominale|débit|débit nominal|caudal|caudal nominal'),
('h_nom', 2, 'напор|высота подачи|давление нагнетания|head|total head|delivery head|discharge head|förderhöhe|druckhöhe|gesamtförderhöhe|prevalenza|altezza manometrica|hauteur|hauteur manométrique|altura|altura manométrica'),
('power_kw', 3, 'мощность|мощн|потребляемая мощность|power|motor power|rated power|shaft power|input power|leistung|motorleistung|nennleistung|wellenleistung|potenza|potenza motore|potenza nominale|puissance|puissance moteur|potencia|potencia motor'),
('rpm', 4, 'обороты|частота вращения|скорость|speed|rpm|rotational speed|rev/min|drehzahl|nenndrehzahl|velocità|giri/min|vitesse|tours/min|velocidad'),
('article', 5, 'артикул|код|каталожный номер|номер заказа|article|code|part number|order number|catalog number|item no|artikelnummer|bestellnummer|katalognummer|codice|articolo|numero d''ordine'),
('dn', 6, 'dn|ду|патрубок|присоединение|фланец|flange|connection|port size|inlet|outlet|suction|discharge|anschluss|nennweite|saugstutzen|druckstutzen'),
('weight', 7, 'масса|вес|weight|mass|net weight|gewicht|masse|peso|massa'), ('npsh', 8, 'npsh|кавитационный запас|npshr|npsh required|haltedruckhöhe'),
('efficiency', 9, 'кпд|эффективность|efficiency|eta|η|wirkungsgrad|rendimento'), ('stages', 10, 'stages|ступени|stufen|stadi')) v(f, i, ws))"""
# each word as it is, in capitals, and torn by a line break; and the bare symbols
WORD_HEADS = "wh AS (SELECT s_suppkey AS table_id, w, CASE s_suppkey % 3 WHEN 0 THEN concat(w, ' [kW]') WHEN 1 THEN concat('  ', upper(w)) ELSE concat(substr(w, 1, 2), chr(10), substr(w, 3)) END AS text FROM supplier, (SELECT DISTINCT w FROM kw) UNION ALL SELECT s_suppkey, s, s FROM supplier, (SELECT unnest(['Q', 'q, m3/h', 'H1', 'P2 (kW)', 'Hx', '', 'x']) AS s))"


@query(
    "t1_header_words",
    f"""WITH {WORDS_SQL}, {WORD_HEADS}, c AS (SELECT *, trim(regexp_replace(regexp_replace(trim(lower(replace(text, chr(10), ' '))), '\s+', ' ', 'g'), '\s*[(\[].*?[)\]]\s*', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(trim(lower(replace(text, chr(10), ''))), '\s+', ' ', 'g'), '\s*[(\[].*?[)\]]\s*', ' ', 'g')) AS b FROM wh),
    m AS (SELECT table_id, c.w, c.text, f, i, length(kw.w) AS score FROM c JOIN kw ON contains(a, kw.w) OR contains(b, kw.w) UNION ALL SELECT table_id, w, text, f, i, 5 FROM c, (VALUES ('q_nom', 1, 'q'), ('h_nom', 2, 'h'), ('power_kw', 3, 'p')) v(f, i, sym) WHERE regexp_matches(a, concat('^', sym, '([^a-z]|$)')))
    SELECT table_id, w, field, score FROM (SELECT table_id, w, f AS field, score, row_number() OVER (PARTITION BY table_id, w ORDER BY score DESC, i) AS r FROM m) WHERE r = 1""",
)
def _(spark, d):
    s = spread(table(spark, d, "supplier").select(F.col("s_suppkey").alias("table_id")), "table_id")
    words = F.array(*map(F.lit, dict.fromkeys(w for own in T.HEADER_WORDS.values() for w in own)))
    w, k = F.col("w"), F.col("table_id") % 3
    rows = s.select("table_id", F.explode(words).alias("w"))
    rows = rows.withColumn("text", F.when(k == 0, F.concat(w, F.lit(" [kW]"))).when(k == 1, F.concat(F.lit("  "), F.upper(w))).otherwise(F.concat(F.substring("w", 1, 2), F.lit("\n"), F.substring("w", 3, 99))))
    bare = s.select("table_id", F.explode(F.array(*map(F.lit, ["Q", "q, m3/h", "H1", "P2 (kW)", "Hx", "", "x"]))).alias("w")).withColumn("text", F.col("w"))
    return T.match_headers(rows.unionByName(bare)).where("field IS NOT NULL").select("table_id", "w", "field", "score")


# tables of suppliers: heads in mm, two dimensions, a dimension twice, and page texts
HEIGHTS = ["H, m", "H (mm)", "H", "Напор, мм", "head"]
HEIGHT_SQL = f"""hs AS (SELECT s_suppkey AS table_id, s_suppkey % 5 AS k, {HEIGHTS}[s_suppkey % 5 + 1] AS h, CASE s_suppkey % 4 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['A', ' a '] WHEN 2 THEN ['L1', 'D2', 'B'] ELSE ['Q', 'x'] END AS ds FROM supplier)"""


@query("t7_drop_heights", f"WITH {HEIGHT_SQL} SELECT table_id, 0 AS col_id, 'model' AS field FROM hs UNION ALL SELECT table_id, 1, 'h_nom' FROM hs WHERE NOT contains(lower(h), 'mm') AND NOT contains(lower(h), 'мм') AND table_id % 4 IN (1, 3)")
def _(spark, d):
    heads, columns = height_tables(spark, d)
    return T.drop_heights(columns, heads)


def height_tables(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("table_id"))
    of = lambda rows: F.element_at(F.array(*(F.array(*map(F.lit, r)) for r in rows)), (F.col("table_id") % 4 + 1).cast("int"))
    dims = s.select("table_id", F.posexplode(of([["A", "B"], ["A", " a "], ["L1", "D2", "B"], ["Q", "x"]])).alias("i", "text")).select("table_id", (F.col("i") + 2).alias("col_id"), "text")
    head = s.select("table_id", F.lit(1).alias("col_id"), F.element_at(F.array(*map(F.lit, HEIGHTS)), (F.col("table_id") % 5 + 1).cast("int")).alias("text"))
    columns = s.select("table_id", F.inline(F.array(F.struct(F.lit(0).alias("col_id"), F.lit("model").alias("field")), F.struct(F.lit(1).alias("col_id"), F.lit("h_nom").alias("field")))))
    return head.unionByName(dims), columns


@query("t7_reject_by_page", "SELECT s_suppkey AS table_id FROM supplier WHERE s_suppkey % 4 <> 2 AND s_suppkey % 7 <> 3")
def _(spark, d):
    heads, _ = height_tables(spark, d)
    k = F.col("s_suppkey") % 7
    text = F.when(k == 3, "Spare parts of pumps").when(k == 4, F.concat(F.repeat(F.lit("x"), 600), F.lit(" installation"))).otherwise("Performance")
    return T.reject_dimension_tables(heads, texts=table(spark, d, "supplier").select(F.col("s_suppkey").alias("table_id"), text.alias("text")))


@query("t5_speeds", "SELECT s_suppkey AS table_id, c AS col_id, CASE WHEN c < 3 THEN 'rpm' END AS field FROM supplier, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS c) WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def _(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_partkey").alias("row_id"), F.col("l_linenumber").alias("n"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("n") % len(values) + 1)
    texts = F.array(pick(["960", "980", "1000", "1450", "1475"]), pick(["1500", "1750", "2900", "2950"]), pick(["3000", "3450", "3500", "3600"]), pick(["720", "1480", "2960"]))
    return T.infer_from_values(line.select("table_id", "row_id", F.posexplode(texts).alias("col_id", "text")))


@query("t2_header_unit", f"WITH {HEADERS} SELECT table_id, col_id, CASE col_id WHEN 1 THEN 'm3/h' END AS q_unit, CASE col_id WHEN 3 THEN 'kw' END AS p_unit FROM headers")
def _(spark, d):
    return headers(spark, d).select("table_id", "col_id", unit_in(F.col("text"), "q").alias("q_unit"), unit_in(F.col("text"), "p").alias("p_unit"))


@query("t3_detect_units", "SELECT s_suppkey AS table_id, 'm3/h' AS q, 'm' AS h, 'kw' AS p FROM supplier")
def _(spark, d):
    heads = headers(spark, d).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "text"))), lambda x: x["text"]).alias("hs"))
    return heads.select("table_id", *(detect_unit(F.col("hs"), F.lit("l/min bar hp"), k).alias(k) for k in "qhp"))


@query("t4_unit_row", "SELECT s_suppkey AS table_id, 1 AS col_id, 'l/s' AS unit FROM supplier")
def _(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("table_id"), F.posexplode(F.array(F.lit("name"), F.lit("l/s"), F.lit("12"))).alias("col_id", "text"))
    return rows.select("table_id", "col_id", unit_in(F.col("text"), "q").alias("unit")).where("unit IS NOT NULL")


@query("t5_infer_from_values", "SELECT s_suppkey AS table_id, c AS col_id, ['model', 'article', 'rpm', NULL, NULL][c + 1] AS field FROM supplier, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS c) WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def _(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_partkey").alias("row_id"), "l_linenumber")
    texts = F.array(F.concat(F.lit("CDM "), F.col("row_id").cast("string")), F.lpad(F.col("row_id").cast("string"), 8, "1"), F.when(F.col("l_linenumber") % 2 == 0, "2900").otherwise("1450"), F.concat("l_linenumber", F.lit(",5")), F.concat(F.lit("DN "), "l_linenumber"))
    return T.infer_from_values(line.select("table_id", "row_id", F.posexplode(texts).alias("col_id", "text")))


@query("t6_resolve_columns", f"WITH {HEADERS}, f AS (SELECT table_id, col_id, CASE WHEN col_id IN (0, 5) THEN 'model' WHEN col_id IN (1, 2) THEN 'q_nom' END AS field, 5 - col_id % 5 AS score FROM headers) SELECT table_id, field, CAST(col_id AS INTEGER) AS col_id, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY table_id, field ORDER BY score DESC, col_id) AS r FROM f WHERE field IS NOT NULL) WHERE r = 1")
def _(spark, d):
    field = F.when(F.col("col_id").isin(0, 5), "model").when(F.col("col_id").isin(1, 2), "q_nom")
    return T.resolve_columns(headers(spark, d).select("table_id", "col_id", field.alias("field"), (5 - F.col("col_id") % 5).alias("score")))


@query("t7_reject_dimension_tables", "SELECT s_suppkey AS table_id FROM supplier WHERE s_suppkey % 3 = 2")
def _(spark, d):
    heads = headers(spark, d)
    more = F.when(F.col("table_id") % 3 == 0, F.array(F.lit("B"), F.lit("L "))).when(F.col("table_id") % 3 == 1, F.array(F.lit("NPSH, m"))).otherwise(F.array(F.lit("x")))
    return T.reject_dimension_tables(heads.unionByName(heads.select("table_id", F.lit(9).alias("col_id"), F.explode(more).alias("text"))))


@query("t8_is_pump_table", f"WITH {CELLS} SELECT table_id, count(DISTINCT row_id) >= 2 AND table_id % 2 = 0 AS pump FROM cells GROUP BY table_id")
def _(spark, d):
    field = F.when(F.col("col_id") == 0, "model").when((F.col("col_id") == 1) & (F.col("table_id") % 2 == 0), "q_nom").otherwise("x")
    return T.is_pump_table(headers(spark, d).select("table_id", "col_id", field.alias("field")), cells(spark, d))


@query("t9_p1_warning", f"WITH {HEADERS} SELECT table_id, col_id FROM headers WHERE contains(lower(text), 'power') AND contains(lower(text), 'p2')")
def _(spark, d):
    low = F.lower("text")
    return headers(spark, d).where(low.contains("power") & low.contains("p2")).select("table_id", "col_id")


@query("t10_rows_to_entries", f"WITH {CELLS}, v AS (SELECT *, CAST(replace(text, ',', '.') AS DOUBLE) AS x FROM cells) SELECT table_id, row_id, max(x) FILTER (col_id = 1) * 3.6::DOUBLE AS q_nom, max(x) FILTER (col_id = 2) AS h_nom, max(x) FILTER (col_id = 3) AS power_kw FROM v WHERE col_id IN (1, 2, 3) GROUP BY ALL")
def _(spark, d):
    columns = headers(spark, d).select("table_id", "col_id", T.header_field(F.col("text"))["field"].alias("field")).where("col_id IN (1, 2, 3)")
    return T.rows_to_entries(cells(spark, d), columns, ["q_nom", "h_nom", "power_kw"], {"q_nom": F.lit("l/s")})


@query("t11_score_assignment", f"WITH {ENTRIES}, e AS (SELECT source_file, {'998.0::DOUBLE * 9.81::DOUBLE * (q_nom / 3600.0::DOUBLE) * h_nom / 1000.0::DOUBLE / power_kw'} AS eta FROM entries WHERE q_nom > 0 AND h_nom > 0 AND power_kw > 0), g AS (SELECT source_file, avg(eta) AS m, count(*) AS n FROM e WHERE eta > 0 AND eta < 1.5::DOUBLE GROUP BY 1) SELECT source_file, round(CASE WHEN n < 2 THEN 999.0::DOUBLE WHEN m < 0.5::DOUBLE THEN 0.5::DOUBLE - m WHEN m > 0.7::DOUBLE THEN m - 0.7::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM g")
def _(spark, d):
    return T.assignment_score(entries(spark, d), ["source_file"], "q_nom", "h_nom", "power_kw").select("source_file", F.round("score", 6).alias("score"))


RUNS = """n AS (SELECT table_id, row_id, col_id, CAST(replace(text, ',', '.') AS DOUBLE) AS x FROM cells), g AS (SELECT *, CASE WHEN coalesce(col_id = lag(col_id) OVER w + 1 AND x > lag(x) OVER w, false) THEN 0 ELSE 1 END AS nw FROM n WINDOW w AS (PARTITION BY table_id, row_id ORDER BY col_id)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY table_id, row_id ORDER BY col_id ROWS UNBOUNDED PRECEDING) AS run FROM g), z AS (SELECT table_id, row_id, run, min(col_id) AS first_col, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 2)"""


@query("t12_detect_qh_matrix", f"WITH {CELLS}, {RUNS} SELECT table_id, row_id, first_col, n FROM (SELECT *, row_number() OVER (PARTITION BY table_id, row_id ORDER BY n DESC, first_col) AS k FROM z) WHERE k = 1")
def _(spark, d):
    return T.numeric_runs(cells(spark, d), least=2)


CURVES = """p AS (SELECT table_id, row_id, col_id * 5.0::DOUBLE AS q, CAST(replace(text, ',', '.') AS DOUBLE) AS h FROM cells), c AS (SELECT table_id, row_id, list(q ORDER BY q) AS qs, list(h ORDER BY q) AS hs FROM p WHERE h > 0 GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT *, list_min(list_transform(range(1, len(qs) + 1), lambda i: {'apart': abs(qs[i] - qs[-1] * 0.65::DOUBLE), 'i': i})).i AS k FROM c)"""


@query("t13_unpivot_qh_matrix", f"WITH {CELLS}, {CURVES} SELECT table_id, row_id, len(qs) AS n, qs[k] AS q_nom, hs[k] AS h_nom FROM b")
def _(spark, d):
    own = cells(spark, d)
    axis = headers(spark, d).select("table_id", F.col("col_id") + 1, "col_id").select("table_id", F.col("(col_id + 1)").alias("col_id"), ((F.col("col_id") + 1) * 5.0).alias("q"))
    return T.unpivot_matrix(own, axis).select("table_id", "row_id", F.size("q_points").cast("long").alias("n"), "q_nom", "h_nom")


@query("t14_detect_transposed", "SELECT l_suppkey AS table_id, count(*) FILTER (r % 2 = 0 AND k <= 10) >= 3 OR (count(*) FILTER (r % 2 = 0) >= 2 AND count(*) FILTER (r % 2 = 0) > count(*) * 0.3::DOUBLE) AS transposed FROM (SELECT l_suppkey, l_partkey AS r, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_partkey").alias("row_id")).distinct()
    first = rows.select("table_id", "row_id", F.lit(0).alias("col_id"), F.when(F.col("row_id") % 2 == 0, "Flow rate").otherwise("x").alias("text"))
    return T.is_transposed(first, ["flow", "head"]).select("table_id", "transposed")


@query("t15_spec_table", f"WITH {CELLS}, l AS (SELECT *, CASE row_id % 3 WHEN 0 THEN 'q_nom' WHEN 1 THEN 'h_nom' ELSE 'power_kw' END AS param, CAST(replace(text, ',', '.') AS DOUBLE) AS x FROM cells) SELECT table_id, col_id, arg_min(x, row_id) FILTER (param = 'q_nom') AS q_nom, arg_min(x, row_id) FILTER (param = 'h_nom') AS h_nom, arg_min(x, row_id) FILTER (param = 'power_kw') AS power_kw FROM l GROUP BY ALL")
def _(spark, d):
    own = cells(spark, d)
    param = F.when(F.col("row_id") % 3 == 0, "q_nom").when(F.col("row_id") % 3 == 1, "h_nom").otherwise("power_kw")
    labels = own.select("table_id", "row_id").distinct().withColumn("param", param)
    return T.transpose_spec(own, labels, ["q_nom", "h_nom", "power_kw"])


@query("t17_models_in_headers", f"WITH {CELLS}, l AS (SELECT *, CAST(replace(text, ',', '.') AS DOUBLE) AS x FROM cells) SELECT table_id, col_id, arg_max(x, row_id) AS last_value FROM l GROUP BY ALL")
def _(spark, d):
    return cells(spark, d).groupBy("table_id", "col_id").agg(F.max_by(N.parse_number(F.col("text")), "row_id").alias("last_value"))


@query("t18_selection_chart", f"WITH {CELLS} SELECT table_id, text AS model, round(avg(col_id * 10.0::DOUBLE), 6) AS q_nom, round(avg((row_id % 30)::DOUBLE), 6) AS h_nom, count(*) AS n FROM cells GROUP BY ALL")
def _(spark, d):
    own, line = cells(spark, d), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_linenumber").alias("col_id"))
    q = line.distinct().withColumn("q", F.col("col_id") * 10.0)
    h = own.select("table_id", "row_id").distinct().withColumn("h", (F.col("row_id") % 30).cast("double"))
    return T.selection_chart(own, q, h, tasks_for(line)).select("table_id", "model", F.round("q_nom", 6).alias("q_nom"), F.round("h_nom", 6).alias("h_nom"), "n")


@query("t20_detect_table_type", "SELECT s_suppkey AS table_id, CASE s_suppkey % 5 WHEN 0 THEN 'transposed' WHEN 1 THEN 'qh_matrix' WHEN 2 THEN 'flat' WHEN 3 THEN 'list' ELSE 'unknown' END AS table_type, CASE s_suppkey % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.85::DOUBLE WHEN 3 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS type_confidence FROM supplier")
def _(spark, d):
    k = F.col("table_id") % 5
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("table_id")).withColumns({
        "transposed": k == 0, "transposed_conf": F.lit(0.9), "matrix": k == 1, "model": k == 2, "q": k == 2, "h": k == 2, "power": F.lit(False),
        "n_cols": F.when(k == 3, 2).otherwise(4), "n_rows": F.lit(6), "curve_header": F.lit(False), "model_lines": F.lit(0),
    })
    return T.table_types(f).select("table_id", "table_type", "type_confidence")


@query("t20_best_table_of_page", "SELECT page, table_id, table_type, c AS type_confidence FROM (SELECT s_suppkey % 10 AS page, s_suppkey AS table_id, concat('t', (s_suppkey % 3)::varchar) AS table_type, (s_suppkey % 7) / 10 AS c, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey % 7 DESC, s_suppkey) AS r FROM supplier) WHERE r = 1")
def _(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("page"), F.col("s_suppkey").alias("table_id"), F.concat(F.lit("t"), (F.col("s_suppkey") % 3).cast("string")).alias("table_type"), ((F.col("s_suppkey") % 7) / 10).alias("type_confidence"))
    return T.best_table(s, ["page"])


@query("t24_split_merged_cells", f"WITH {CELLS} SELECT table_id, row_id, col_id, CAST(part AS INTEGER) AS part, CASE part WHEN 0 THEN text ELSE 'LVR 2' END AS text FROM cells, (SELECT unnest([0, 1]) AS part)")
def _(spark, d):
    return T.split_merged(cells(spark, d).withColumn("text", F.concat("text", F.lit("\n LVR 2"))))


@query("t25_forward_fill", f"WITH {CELLS}, b AS (SELECT table_id, row_id, col_id, CASE WHEN row_id % 3 = 0 THEN '' ELSE text END AS text FROM cells) SELECT table_id, row_id, col_id, CASE WHEN col_id = 1 THEN coalesce(last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY table_id, col_id ORDER BY row_id ROWS UNBOUNDED PRECEDING), text) ELSE text END AS text FROM b")
def _(spark, d):
    return T.forward_fill(cells(spark, d).withColumn("text", F.when(F.col("row_id") % 3 == 0, "").otherwise(F.col("text"))), 1)


@query("t26_q_header", f"WITH {CELLS}, n AS (SELECT table_id, row_id, count(*) FILTER (TRY_CAST(replace(text, ',', '.') AS DOUBLE) IS NOT NULL) AS k FROM cells GROUP BY ALL) SELECT table_id, min(row_id) AS row_id FROM n WHERE k >= 3 GROUP BY table_id")
def _(spark, d):
    n = cells(spark, d).groupBy("table_id", "row_id").agg(F.count_if(N.parse_number(F.col("text")).isNotNull()).alias("k"))
    return n.where("k >= 3").groupBy("table_id").agg(F.min("row_id").alias("row_id"))


@query("t27_is_performance_table", f"WITH {HEADERS} SELECT table_id, bool_or(contains(lower(text), 'm3/h') OR contains(lower(text), 'head')) AS performance FROM headers GROUP BY table_id")
def _(spark, d):
    low = F.lower("text")
    return headers(spark, d).groupBy("table_id").agg(F.bool_or(low.contains("m3/h") | low.contains("head")).alias("performance"))


@query("t28_pick_extraction", f"WITH {ENTRIES}, m AS (SELECT source_page, avg(CASE WHEN q_nom > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m FROM entries WHERE data_source = 'catalog_curve' GROUP BY 1), f AS (SELECT source_page, avg(CASE WHEN q_nom > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM entries WHERE data_source = 'estimated' GROUP BY 1) SELECT source_page, CASE WHEN m > 0.5::DOUBLE AND f < m THEN 'fallback' ELSE 'main' END AS choice FROM m LEFT JOIN f USING (source_page)")
def _(spark, d):
    own = entries(spark, d)
    return T.choose_extraction(own.where("data_source = 'catalog_curve'"), own.where("data_source = 'estimated'"), "source_page", F.col("q_nom") > 20)


@query("t22_direct_map_fallbacks", f"WITH {CELLS}, v AS (SELECT *, CAST(replace(text, ',', '.') AS DOUBLE) AS x FROM cells) SELECT table_id, row_id, coalesce(max(x) FILTER (col_id = 2 AND x > 25), max(x) FILTER (col_id = 3), max(x) FILTER (col_id = 4), 0.0::DOUBLE) AS h FROM v GROUP BY ALL")
def _(spark, d):
    x = N.parse_number(F.col("text"))
    at = lambda c: F.max(F.when(c, x))
    return cells(spark, d).groupBy("table_id", "row_id").agg(F.coalesce(at((F.col("col_id") == 2) & (x > 25)), at(F.col("col_id") == 3), at(F.col("col_id") == 4), F.lit(0.0)).alias("h"))


@query("t23_header_row_record", "SELECT p_partkey, p_size::varchar AS last_part FROM part")
def _(spark, d):
    dotted = F.concat(F.lit("Model.Q."), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.element_at(F.filter(F.split(dotted, r"\."), lambda x: x != ""), -1).alias("last_part"))


@query("w8_pick_extractor")
def _(spark, d):
    """Results of three extractors for each page; the choice depends on their order, step by step."""
    own = entries(spark, d)
    score = F.floor(F.avg("confidence") * 100)
    results = own.groupBy("source_file", "source_page", F.col("data_source").alias("extractor")).agg(F.count("*").alias("n"), score.alias("score"))
    place = F.when(F.col("extractor") == "catalog_curve", 0).when(F.col("extractor") == "catalog_nominal", 1).otherwise(2)
    return T.sequential_pick(results.withColumn("place", place), ["source_file", "source_page"])


@query("w9_retry_pick", f"WITH {ENTRIES}, r AS (SELECT source_page, data_source, 40 + count(*) % 60 AS score FROM entries GROUP BY ALL), g AS (SELECT *, CASE WHEN score >= 90 THEN 0 ELSE 1 END AS late FROM r) SELECT source_page, data_source, score FROM (SELECT *, row_number() OVER (PARTITION BY source_page ORDER BY late, CASE WHEN late = 0 THEN 0 ELSE -score END, data_source) AS k FROM g) WHERE k = 1")
def _(spark, d):
    r = entries(spark, d).groupBy("source_page", "data_source").agg((40 + F.count("*") % 60).alias("score"))
    late = F.when(F.col("score") >= 90, 0).otherwise(1)
    best = r.groupBy("source_page").agg(F.min(F.struct(late.alias("late"), F.when(late == 0, 0).otherwise(-F.col("score")).alias("s"), "data_source", "score")).alias("b"))
    return best.select("source_page", "b.data_source", "b.score")


@query(
    "p14_spans_to_rows",
    """WITH RECURSIVE sp AS (SELECT l_orderkey % 500 AS page, l_quantity * 2 AS y, l_extendedprice AS x, l_returnflag AS text FROM lineitem), h AS (SELECT DISTINCT page, y FROM sp),
    nxt AS (SELECT h.page, h.y, min(k.y) AS p FROM h JOIN h k ON h.page = k.page AND k.y - h.y > 3.0::DOUBLE GROUP BY ALL),
    a AS (SELECT page, min(y) AS y FROM h GROUP BY page UNION ALL SELECT a.page, p FROM a JOIN nxt ON a.page = nxt.page AND a.y = nxt.y),
    n AS (SELECT page, y, lead(y) OVER w AS upto, CAST(row_number() OVER w - 1 AS INTEGER) AS row_no FROM a WINDOW w AS (PARTITION BY page ORDER BY y))
    SELECT sp.page, sp.y, x, text, row_no, CAST(row_number() OVER (PARTITION BY sp.page, row_no ORDER BY x, text) - 1 AS INTEGER) AS col_no FROM sp JOIN n ON sp.page = n.page AND sp.y >= n.y AND (n.upto IS NULL OR sp.y < n.upto)""",
)
def _(spark, d):
    """Spans at the places of a supplier's line items; rows follow from the first span of the open row."""
    spans = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("page"), (F.col("l_quantity") * 2).alias("y"), F.col("l_extendedprice").alias("x"), F.col("l_returnflag").alias("text"))
    return T.span_rows(spans, ["page"])
