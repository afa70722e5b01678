"""Extraction by templates and by types of pages, over pages made of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from .inputs import table
from .registry import query

TEMPLATES = [
    ("series", "nbs", r"NBS\s+(\d+-\d+)\s+([\d,.]+)\s+([\d,.]+)", ["model", "q_nom", "h_nom"]),
    ("series", "nbs-power", r"NBS\s+(\d+-\d+)\s+P2\s*=\s*([\d,.]+)", ["model", "power_kw"]),
    ("motors", "motor", r"(?m)^([A-Z]{2}\d+)\s*:\s*([\d,.]+)\s*kW(?:\s+(\d{4}) rpm)?", ["model", "power_kw", "rpm"]),
    ("nobody", "unused", "(.*)", ["model"]),
]
TEXTS = {
    "series": "concat('NBS ', n, '-', k % 9, '  12,5  ', n + 3, chr(10), 'and NBS ', n, '-', k % 9, ' P2 = 7.5', chr(10), 'NBS ', n + 1, '-1 8 9')",
    "motors": "concat('AB', n, ': 2,2 kW 2900 rpm', chr(10), 'x CD', n, ': 3 kW', chr(10), 'EF', k % 10, ': 4 kW')",
    "list_parser": "concat('n = 1450 rpm', chr(10), 'TD', n, '-14G/2 8 14,5 2900 0,75', chr(10), 'TL', n, '-20/4 9 20', chr(10), 'end')",
    "flat_table": "concat('CMI ', n, '-2 12345678 5 ', n + 1, ',5 0,55', chr(10), 'CMI ', n, '-3 1234567 6 7 ', n)",
    "curve_table": "concat('Q (m³/h)  0  5  10', chr(10), 'CDM ', n, '-3  1,1  ', n + 9, '  ', n + 8, '  ', n + 7)",
    "unknown": "concat('CMI ', n, '-2 12345678 5 6 7')",
}
KINDS = list(TEXTS)
TYPED = f"""typed_pages AS (SELECT k % 50 AS source_file, k AS page_num, type, CASE type {' '.join(f"WHEN '{t}' THEN {x}" for t, x in TEXTS.items())} END AS text
  FROM (SELECT p_partkey AS k, p_size AS n, CASE p_partkey % {len(KINDS)} {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(KINDS))} END AS type FROM part))"""


def typed_pages(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(f"WITH {TYPED} SELECT * FROM typed_pages")


NUMBER = "TRY_CAST(replace({0}, ',', '.') AS DOUBLE)"


def template_sql(kind: str, name: str, pattern: str, fields: list[str]) -> str:
    """The matches of one template, cut out of the text one by one."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT source_file, page_num, type, '{name}' AS template, unnest(range(0, len(ms))) AS place, unnest(ms) AS m, {', '.join(f"regexp_extract(unnest(ms), '{pattern}', {fields.index(f) + 1})" if f in fields else 'NULL' + ' AS VARCHAR' * 0 for f in ('model', 'q_nom', 'h_nom', 'power_kw', 'rpm'))}
    FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS ms FROM typed_pages WHERE type = '{kind}')"""


TEMPLATE_SQL = "tm(source_file, page_num, type, template, place, m, model, q, h, p, r) AS (" + " UNION ALL ".join(template_sql(*t) for t in TEMPLATES) + ")"


def templates(spark):
    return spark.createDataFrame(TEMPLATES, X.TEMPLATE)


@query(
    "x2_template_records",
    f"""WITH {TYPED}, {TEMPLATE_SQL} SELECT source_file, page_num, type, template, place, model, {NUMBER.format("q")} AS q_nom, {NUMBER.format("h")} AS h_nom, {NUMBER.format("p")} AS power_kw, TRY_CAST(r AS INTEGER) AS rpm FROM tm""",
)
def _(spark, d):
    found = X.template_records(typed_pages(spark, d), templates(spark))
    value = lambda x: F.try_element_at("fields", F.lit(x))
    return found.select("source_file", "page_num", "type", "template", "place", value("model").alias("model"), *(X.parse_number(value(x)).alias(x) for x in ("q_nom", "h_nom", "power_kw")), value("rpm").cast("int").alias("rpm"))


OWN = "source_file, page_num, type"
FIXED = {
    "list_parser": f"SELECT {OWN}, unnest([0, 1]) AS place, unnest([concat('TD', n, '-14G/2'), concat('TL', n, '-20/4')]) AS model, unnest(['TD', 'TL']) AS series, NULL AS article, unnest([8.0, 9.0]) AS q_nom, unnest([14.5, 20.0]) AS h_nom, unnest([0.75, 0.0]) AS power_kw, unnest([2900, 1450]) AS rpm, 0.75 AS confidence FROM tp WHERE type = 'list_parser'",
    "flat_table": f"SELECT {OWN}, unnest([0, 1]), unnest([concat('CMI ', n, '-2'), concat('CMI ', n, '-3')]), 'CMI', unnest(['12345678', '1234567']), unnest([5.0, 6.0]), unnest([n + 1.5, 7.0]), unnest([0.55, n]), NULL, 0.9 FROM tp WHERE type = 'flat_table'",
    "curve_table": f"SELECT {OWN}, 1, concat('CDM ', n, '-3'), 'CDM', NULL, 5.0, n + 8, 1.1, 0, 0.8 FROM tp WHERE type = 'curve_table'",
}
RUN_SQL = "tp AS (SELECT t.*, p_size AS n FROM typed_pages t JOIN part ON page_num = p_partkey), " + ", ".join(f"{t}_rows AS ({x})" for t, x in FIXED.items())
COLUMNS = f"{OWN}, extractor, place, model, series, article, q_nom, h_nom, power_kw, rpm, confidence"


@query(
    "x1_extractors",
    f"""WITH {TYPED}, {TEMPLATE_SQL}, tp AS (SELECT t.*, p_size AS n FROM typed_pages t JOIN part ON page_num = p_partkey),
    found AS (SELECT 'list_parser' AS extractor, * FROM ({FIXED['list_parser']}) UNION ALL SELECT 'flat_table', * FROM ({FIXED['flat_table']}) UNION ALL SELECT 'curve_table', * FROM ({FIXED['curve_table']})
      UNION ALL SELECT 'series', {OWN}, place, model, upper(regexp_extract(model, '^[A-Za-z]{{2,6}}')), NULL, {NUMBER.format('q')}, {NUMBER.format('h')}, {NUMBER.format('p')}, NULL, NULL FROM tm WHERE type = 'series')
    SELECT {COLUMNS.replace('place,', 'CAST(place AS BIGINT) AS place,').replace('q_nom, h_nom, power_kw, rpm, confidence', ', '.join(f'{x}::DOUBLE AS {x}' for x in ('q_nom', 'h_nom', 'power_kw')) + ', rpm::INTEGER AS rpm, confidence::DOUBLE AS confidence')} FROM found""",
)
def _(spark, d):
    own = X.Extractors()
    own.register("series", X.by_templates(templates(spark)))
    return own.run(typed_pages(spark, d)).selectExpr(*COLUMNS.split(", "))
