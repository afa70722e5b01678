"""Rules on whole pages, page joins of models, and transposed tables, over pages and tables made of the parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import page_rules as R
from ..operators import pages as P
from ..operators import tables as T
from .inputs import PAGES, pages, table, spread
from .registry import query

KINDS = [
    "concat('Technical data of the pump, page ', k, ' of the catalogue, for all who read it on and on')", "concat('125-6* and so on, power in kW for the motor, nothing else in this line ', k)", "concat('pump kW 1 2 3 4 5 6 7 8 9 10 11 12 and more words for the length ', n)",
    "concat('CDMF1+CMH', n, '-2 with Q (м³/ч) and H (м) as in the other lines of this page')", "'short pump table'", "concat('Only prose here without numbers of interest, but long enough to be looked at, ', 'really')",
    "concat('flow 1,5 2,5 3.5 4,5 ', n, '.5 end of this page'), NULL", "concat('CDM ', n, '-2 1.1 1.2 1.3 1.4 1.5 1.6 1.7 1.8 1.9 2.0 Q nom [m3/h] | Model |')", "concat('H [m] P2 [kW] Насос | Article  | ', repeat('x', 1500), ' pump table kW 125-6')",
]
KINDS[6] = KINDS[6].removesuffix(", NULL")
RULED = f"""ruled AS (SELECT k % 40 AS source_file, k AS page_num, kind, n, CASE kind {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(KINDS))} END AS text FROM (SELECT p_partkey AS k, CAST(p_partkey % 10 AS INTEGER) AS kind, CAST(p_size AS INTEGER) AS n FROM part))"""


def ruled(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(f"WITH {RULED} SELECT * FROM ruled")


# what each kind is, by reading it
@query("p6_quick_check_rules", f"WITH {RULED} SELECT page_num, coalesce(kind IN (0, 1, 2, 3), false) AS found, CASE WHEN kind IN (1) THEN 'CDM' WHEN kind = 3 THEN 'CDMF+CMH' END AS kind FROM ruled")
def _(spark, d):
    return ruled(spark, d).select("page_num", R.quick_check(F.col("text")).alias("r")).select("page_num", "r.found", "r.kind")


@query("p5_pages_to_read", f"WITH {RULED}, tb AS (SELECT source_file, page_num FROM ruled WHERE source_file % 4 = 1 AND kind < 3) SELECT source_file, page_num FROM tb UNION ALL SELECT source_file, page_num FROM ruled WHERE source_file NOT IN (SELECT source_file FROM tb) AND kind IN (6, 7)")
def _(spark, d):
    own = ruled(spark, d)
    return R.pages_to_read(own, own.where("source_file % 4 = 1 AND kind < 3").select("source_file", "page_num"))


@query("p24_header_signatures", f"WITH {RULED} SELECT page_num, CASE WHEN kind = 7 THEN 'Q nom [m3/h];Model |' WHEN kind = 8 THEN 'H [m];P2 [kW];Насос |;Article |' WHEN text IS NOT NULL THEN '' END AS signatures FROM ruled")
def _(spark, d):
    found = R.signatures(F.col("text"))
    return ruled(spark, d).select("page_num", F.array_join(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " ")), ";").alias("signatures"))


PARTS_OF_NAMES = [("CDM_CDMF_241125", "CDM"), ("x_cdlf_modeli_120.pdf", "CDLF_LARGE"), ("my cdlf.pdf", "CDLF"), ("cdmf-2.pdf", "CDMF_FANCY"), ("cdmf_modeli_32", "CDMF_LARGE"), ("Каталог INL", "INL"), ("Katalog-TG 2020", "TG"), ("other", "UNKNOWN"), ("CDLF", "UNKNOWN"), ("rkohe9dt", "VO")]


@query("p22_catalog_types", f"SELECT p_partkey, [{', '.join(repr(t) for _, t in PARTS_OF_NAMES)}][p_partkey % 10 + 1] AS type FROM part")
def _(spark, d):
    name = F.element_at(F.array(*(F.lit(n) for n, _ in PARTS_OF_NAMES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", R.catalog_type(name).alias("type"))


@query("p20_brands_of_series", "SELECT p_partkey, CASE lower(substr(p_type, 1, 2)) WHEN 'ec' THEN 'Alpha' WHEN 'pr' THEN 'Beta' ELSE 'Unknown' END AS brand FROM part")
def _(spark, d):
    brands = spark.createDataFrame([("EC", "Alpha"), (" pr", "Beta"), ("zz", "Gamma")], "series string, brand string")
    return R.brand_for_series(table(spark, d, "part").select("p_partkey", F.lower(F.substring("p_type", 1, 2)).alias("series")), brands).select("p_partkey", "brand")


@query(
    "q14_worklist",
    """WITH m AS (SELECT l_suppkey AS source_file, l_orderkey % 40 AS page_num, bool_and(l_quantity > 5) AS whole FROM lineitem WHERE l_suppkey % 5 <> 0 AND l_orderkey % 3 = 0 GROUP BY ALL), t AS (SELECT DISTINCT l_suppkey AS source_file, l_orderkey % 40 AS page_num FROM lineitem WHERE l_suppkey % 10 <> 5 AND l_orderkey % 2 = 0), p AS (SELECT DISTINCT l_suppkey AS source_file, l_orderkey % 40 AS page_num FROM lineitem),
    k AS (SELECT source_file, page_num, CASE WHEN whole IS NULL THEN 'extract' WHEN NOT whole THEN 'validate' END AS task FROM m FULL JOIN t USING (source_file, page_num))
    SELECT * FROM k WHERE task IS NOT NULL UNION ALL SELECT source_file, page_num, 'extract' FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page_num) AS r FROM p WHERE source_file NOT IN (SELECT source_file FROM k)) WHERE r <= 10""",
)
def _(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_file"), (F.col("l_orderkey") % 40).alias("page_num"), "l_orderkey", (F.col("l_quantity") > 5).alias("complete"))
    models = line.where("source_file % 5 <> 0 AND l_orderkey % 3 = 0")
    tables = line.where("source_file % 10 <> 5 AND l_orderkey % 2 = 0")
    return R.page_worklist(models, tables, line)


# models of the pages of documents: three for each page, some sure, some not
MODELS = "pm AS (SELECT source_file, page_num, text, i, CASE i WHEN 0 THEN 't-he' WHEN 1 THEN 'zzz 1' ELSE 'The' END AS model, CAST(page_num % 40 AS DOUBLE) AS q, CAST((page_num + i) % 25 AS DOUBLE) AS h, 0.0::DOUBLE AS kw, CASE WHEN i = 2 THEN 0.9::DOUBLE ELSE (page_num % 10) / 10 END AS cq, CASE WHEN i = 2 THEN 0.85::DOUBLE ELSE (page_num % 7) / 10 END AS ch FROM pages_in, (SELECT unnest([0, 1, 2]) AS i))"
SEEN = "list_filter(list_transform(regexp_extract_all(text, '[0-9]+[.,]?[0-9]*'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)), lambda x: x >= {0}::DOUBLE AND x <= {1})"


def verified_sql(x: str, low: float, high: float) -> str:
    return f"{SEEN.format(low, high)} AS n{x}, named AND {x} > 0 AND len(list_filter({SEEN.format(low, high)}, lambda n: n > 0 AND abs(n - {x}) / greatest(n, {x}) <= 0.05::DOUBLE)) > 0 AS y{x}, list_min(list_transform({SEEN.format(low, high)}, lambda n: {{'a': abs(n - {x}), 'n': n}})).n AS c{x}n"


@query(
    "j15_verify_models",
    f"""WITH {PAGES}, {MODELS}, a AS (SELECT *, contains(regexp_replace(upper(text), '[\\s\\-]', '', 'g'), regexp_replace(upper(model), '[\\s\\-]', '', 'g')) AND ((q > 0 AND cq < 0.8::DOUBLE) OR (h > 0 AND ch < 0.8::DOUBLE)) AS named FROM pm), b AS (SELECT *, {verified_sql('q', 0.1, 1000)}, {verified_sql('h', 0.5, 500)} FROM a)
    SELECT page_num, i, CASE WHEN NOT coalesce(yq, false) AND named AND q > 0 AND cq <= 0.5::DOUBLE AND cqn > 0 THEN cqn ELSE q END AS q, CASE WHEN NOT coalesce(yh, false) AND named AND h > 0 AND ch <= 0.5::DOUBLE AND chn > 0 THEN chn ELSE h END AS h,
      CASE WHEN yq THEN least(1.0::DOUBLE, cq + 0.3::DOUBLE) WHEN named AND q > 0 AND cq <= 0.5::DOUBLE AND cqn > 0 THEN 0.7::DOUBLE ELSE cq END AS confidence_q, CASE WHEN yh THEN least(1.0::DOUBLE, ch + 0.3::DOUBLE) WHEN named AND h > 0 AND ch <= 0.5::DOUBLE AND chn > 0 THEN 0.7::DOUBLE ELSE ch END AS confidence_h,
      CASE WHEN NOT coalesce(yq, false) AND named AND q > 0 AND cq <= 0.5::DOUBLE AND cqn > 0 THEN 'ocr' ELSE 'docling' END AS source_q FROM b""",
)
def _(spark, d):
    own = pages(spark, d)
    own.createOrReplaceTempView("pages_in")
    models = spark.sql("SELECT source_file, page_num, i, CASE i WHEN 0 THEN 't-he' WHEN 1 THEN 'zzz 1' ELSE 'The' END AS model, CAST(page_num % 40 AS DOUBLE) AS q, CAST((page_num + i) % 25 AS DOUBLE) AS h, 0.0D AS kw, CASE WHEN i = 2 THEN 0.9D ELSE (page_num % 10) / 10 END AS confidence_q, CASE WHEN i = 2 THEN 0.85D ELSE (page_num % 7) / 10 END AS confidence_h, 0.0D AS confidence_kw, 'docling' AS source_q, 'docling' AS source_h, '' AS source_kw FROM pages_in LATERAL VIEW explode(array(0, 1, 2)) AS i")
    return R.verify_models(models, own).select("page_num", "i", "q", "h", "confidence_q", "confidence_h", "source_q")


@query(
    "j16_confirm_models",
    f"""WITH {PAGES}, m AS (SELECT *, page_num * 1.0::DOUBLE AS q, CASE i WHEN 0 THEN 'The-12' WHEN 1 THEN 'qqq/wwwww' ELSE 'x' END AS model FROM pages_in, (SELECT unnest([0, 1, 2]) AS i)), f AS (SELECT *, i = 0 AND contains(lower(text), 'the') AS named, q <> 0 AND (list_contains(list_transform(regexp_extract_all(text, '\\d+[.,]\\d+|\\d+'), lambda x: replace(x, ',', '.')), concat(page_num, '.0')) OR contains(text, concat(page_num, ',0')) OR list_contains(list_transform(regexp_extract_all(text, '\\d+[.,]\\d+|\\d+'), lambda x: replace(x, ',', '.')), '7.5') OR contains(text, '7,5')) AS num FROM m WHERE i < 2)
    SELECT page_num, i, CASE WHEN named AND num THEN 0.75::DOUBLE WHEN named OR num THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END AS confidence, CASE WHEN named OR num THEN 'gemini' ELSE 'gemini_unverified' END AS data_source FROM f WHERE page_num > 0""",
)
def _(spark, d):
    own = pages(spark, d)
    own.createOrReplaceTempView("pages_in")
    models = spark.sql("SELECT source_file, page_num, i, CASE i WHEN 0 THEN 'The-12' WHEN 1 THEN 'qqq/wwwww' ELSE 'x' END AS model, page_num * 1.0D AS q_nom, 7.5D AS h_nom, 0.0D AS power_kw, 0.0D AS confidence, 'gemini' AS data_source FROM pages_in LATERAL VIEW explode(array(0, 1, 2)) AS i WHERE page_num > 0")
    return R.confirm_models(models, own).select("page_num", "i", "confidence", "data_source")


@query("p28_combined_points", "WITH x AS (SELECT p_partkey, p_size AS n, unnest([0.0::DOUBLE, 10, 20]) AS q, unnest([p_size + 20.5::DOUBLE, p_size + 10, 5]) AS h FROM part WHERE p_partkey % 4 <> 3) SELECT p_partkey, concat('CDMF', n, '-2+CMH', n, '-3') AS id, 0.92::DOUBLE AS kw, q, h FROM x")
def _(spark, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    line = F.concat(F.lit(" CDMF"), n, F.when(k == 0, "-2+CMH").when(k == 3, "-2 CMH").otherwise("-2+CM  H"), n, F.when(k == 1, "-3 0 .37+0. 55  ").otherwise("-3 0,37+0.55  "), (F.col("p_size") + 20).cast("string"), F.lit(",5 700 "), (F.col("p_size") + 10).cast("string"), F.lit(".0 -3 5.0"))
    return R.combined_points(table(spark, d, "part").select("p_partkey", line.alias("line"), F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(30.0)).alias("q")), "line", "q")


@query("p13_blocks_with_tables", "SELECT p_partkey, CAST(b AS BIGINT) AS block_no, n_lines, CASE b WHEN 0 THEN 5.0::DOUBLE ELSE 9.0::DOUBLE END AS left, CASE WHEN b = 1 AND p_size % 2 = 1 THEN 9.0::DOUBLE + 16 * 10.0::DOUBLE * 0.5::DOUBLE WHEN b = 0 THEN 5.0::DOUBLE + 13 * 10.0::DOUBLE * 0.5::DOUBLE ELSE 11.0::DOUBLE + 7 * 10.0::DOUBLE * 0.5::DOUBLE END AS right, b = 1 AND p_size % 2 = 1 AS table_like FROM part, (VALUES (0, 2), (1, 3)) v(b, n_lines)")
def _(spark, d):
    row = lambda no, y, x, text: F.struct(F.lit(no).alias("line_no"), F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x0"), F.lit(10.0).alias("font_size"), text.alias("line"))
    odd = F.col("p_size") % 2 == 1
    third = F.when(odd, "a  b  c").otherwise("one   2")
    rows = F.array(row(0, 0, 5, F.lit("Heading of it")), row(1, 15, 7, F.lit("x  y  z")), row(2, 60, 9, F.when(odd, "Model  Flow  Hxx").otherwise("M  Q")), row(3, 80, 10, F.when(odd, "A  1  2").otherwise("A")), row(4, 95, 11, third))
    own = table(spark, d, "part").select("p_partkey", "p_size", F.inline(rows))
    out = P.blocks(own, ["p_partkey"])
    return out.select("p_partkey", "block_no", "n_lines", "left", "right", "table_like")


TRANSPOSED = ["Расход, м3/ч|8-12,5|{n}|x", "Head|10 – 20|7|0", "Flow max|9-11|{n}|", "Speed rpm|1450|700|2900", "Power kW|1,1|2|3"]
TR_KINDS = {0: TRANSPOSED, 1: TRANSPOSED[:2], 2: ["Alpha|1|2|3", "Beta|4|5|6", "Flow|7|8|9"], 3: ["Model|A|B|C", "Prevalenza|{n}|5,5|-", "Potenza|1|2|3"]}


@query(
    "t16_transposed_records",
    """WITH x AS (SELECT p_partkey AS table_id, CAST(p_size AS DOUBLE) AS n, p_partkey % 4 AS kind FROM part)
    SELECT table_id, unnest([1, 2]) AS col_id, unnest(['TG 32', 'TG 40']) AS model, unnest([10.0::DOUBLE, n]) AS q, unnest([15.0::DOUBLE, 7.0]) AS h, unnest([1.1::DOUBLE, 2.0]) AS p, unnest([1450, 2950]) AS rpm FROM x WHERE kind = 0
    UNION ALL SELECT table_id, unnest([1, 2]), unnest(['TG 32', 'TG 40']), 0.0, unnest([n, 5.5::DOUBLE]), unnest([1.0::DOUBLE, 2.0]), 2950 FROM x WHERE kind = 3""",
)
def _(spark, d):
    spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").createOrReplaceTempView("part")
    fill = lambda text: "concat(" + ", ".join(f"'{p}'" if i % 2 == 0 else "p_size" for i, p in enumerate(text.replace("{n}", "\0n\0").split("\0"))) + ")"
    rows = "CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN array({', '.join(map(fill, own))})" for k, own in TR_KINDS.items()) + " END"
    cells = spark.sql(f"WITH r AS (SELECT p_partkey AS table_id, posexplode({rows}) AS (row_id, line) FROM part) SELECT table_id, row_id, posexplode(split(line, '[|]')) AS (col_id, text) FROM r")
    heads = table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.posexplode(F.array(*map(F.lit, ["Параметр", "TG 32", "TG 40 ", "TG 50"]))).alias("col_id", "text"))
    heads = heads.withColumn("text", F.when((F.col("col_id") == 3) & (F.col("table_id") % 4 == 0), "T").otherwise(F.col("text")))
    return T.transposed_records(cells, heads, table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.lit(2950).alias("rpm")))
