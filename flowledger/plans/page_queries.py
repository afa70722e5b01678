"""Queries over page texts. The prose of the test tables has no pump words, so word lists and patterns are given."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import numbers_in
from ..operators import pages as P
from ..operators import recipes
from .inputs import PAGES, pages, table
from .registry import query

WORDS = ["the", "of", "and", "thndor", "oner", "zz-none"]
OTHER = {"data": ["ther", "ing", "ander", "que"], "graph": ["der", "ung"], "skip": ["keit", "ción", "tion"], "cover": ["eux"], "contents": ["ado"], "model_code": ["pf"], "model_range": ["nté"]}


def _score(words: list[str], text: str = "lower(text)") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + ")"


@query("s1_read_pages", f"WITH {PAGES} SELECT source_file, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM pages_in GROUP BY source_file")
def _(spark, d):
    return pages(spark, d).groupBy("source_file").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


@query("p1_keyword_score", f"WITH {PAGES} SELECT page_num, {_score(WORDS)} AS score FROM pages_in")
def _(spark, d):
    return pages(spark, d).select("page_num", P.keyword_score(F.col("text"), WORDS).alias("score"))


CLASSIFIED = f"""s AS (SELECT page_num, source_file, text, lower(trim(text)) AS low, {", ".join(f"{_score(w, 'lower(trim(text))')} AS s_{k}" for k, w in OTHER.items())},
  len(regexp_extract_all(text, '[A-ZА-ЯЁ]{{2,6}}[\\s\\-]?\\d{{1,3}}[\\s\\-/]\\d{{1,3}}')) AS models, len(regexp_extract_all(text, '(?:[\\d]+[.,]?\\d*\\s+){{3,}}[\\d]+[.,]?\\d*')) AS nrows,
  regexp_matches(text, '(?i)Q\\s*[\\(\\[]?\\s*(?:м[³3]/ч|m[³3]/h|m3/h|l/min|gpm|л/мин)') AS qh, regexp_matches(text, '(?i)(?:м³/ч|m³/h|m3/h|квт|kw|hp|об/мин|rpm|л/с|l/s|gpm)') AS un FROM pages_in),
t AS (SELECT *, [{{'t': 'dimensions', 's': CASE WHEN contains(low, 'dimension') OR contains(low, 'габарит') THEN s_skip ELSE 0 END}}, {{'t': 'installation', 's': CASE WHEN contains(low, 'installation') OR contains(low, 'инструкция') THEN s_skip ELSE 0 END}},
  {{'t': 'materials', 's': CASE WHEN contains(low, 'material') OR contains(low, 'материал') THEN s_skip ELSE 0 END}},
  {{'t': 'data_table', 's': s_data + CASE WHEN models >= 3 THEN 3 WHEN models >= 1 THEN 1 ELSE 0 END + CASE WHEN nrows >= 3 THEN 2 ELSE 0 END + CASE WHEN qh THEN 2 ELSE 0 END + CASE WHEN un THEN 1 ELSE 0 END}},
  {{'t': 'data_graph', 's': s_graph + CASE WHEN qh THEN 2 ELSE 0 END}}, {{'t': 'cover', 's': s_cover + CASE WHEN page_num = 0 THEN 2 ELSE 0 END}}, {{'t': 'toc', 's': s_contents}}, {{'t': 'model_code', 's': s_model_code}}, {{'t': 'model_range', 's': s_model_range}}] AS sc FROM s),
b AS (SELECT *, list_max(list_transform(sc, lambda x: x.s)) AS best FROM t),
k AS (SELECT *, list_filter(sc, lambda x: x.s = best)[1].t AS kind0 FROM b),
f AS (SELECT *, CASE WHEN s_skip >= 2 AND kind0 NOT IN ('data_table', 'data_graph') AND (contains(low, 'dimension') OR contains(low, 'габарит')) THEN 'dimensions' WHEN s_skip >= 2 AND kind0 NOT IN ('data_table', 'data_graph') AND (contains(low, 'installation') OR contains(low, 'инструкция')) THEN 'installation'
  WHEN s_skip >= 2 AND kind0 NOT IN ('data_table', 'data_graph') AND (contains(low, 'material') OR contains(low, 'материал')) THEN 'materials' ELSE kind0 END AS kind1, best <= 1 AND nrows >= 5 AND models >= 2 AS dense FROM k),
classified AS (SELECT page_num, source_file, CASE WHEN length(low) < 30 THEN CASE WHEN page_num < 3 THEN 'cover' ELSE 'other' END WHEN dense THEN 'data_table' WHEN best <= 1 AND page_num = 0 THEN 'cover' WHEN best <= 1 THEN 'other' ELSE kind1 END AS page_type,
  CASE WHEN length(low) < 30 THEN 0.5::DOUBLE ELSE least(0.95::DOUBLE, 0.5::DOUBLE + CASE WHEN dense THEN 3 ELSE best END * 0.1::DOUBLE) END AS type_confidence FROM f)"""


@query("p2_classify_pages", f"WITH {PAGES}, {CLASSIFIED} SELECT page_num, page_type, type_confidence FROM classified")
def _(spark, d):
    return P.classify(pages(spark, d), keywords=OTHER).select("page_num", "page_type", "type_confidence")


@query("p3_page_type_counts", f"WITH {PAGES}, {CLASSIFIED} SELECT page_type, count(*) AS n FROM classified GROUP BY page_type")
def _(spark, d):
    return P.classify(pages(spark, d), keywords=OTHER).groupBy("page_type").agg(F.count("*").alias("n"))


@query("v8_page_type_gate", f"WITH {PAGES}, {CLASSIFIED} SELECT page_num, source_file FROM classified WHERE page_type IN ('data_table', 'model_range', 'data_graph')")
def _(spark, d):
    return P.classify(pages(spark, d), keywords=OTHER).where(F.col("page_type").isin(P.DATA_TYPES)).select("page_num", "source_file")


@query("p4_is_data_page", f"WITH {PAGES} SELECT page_num FROM pages_in WHERE NOT (contains(lower(text), 'copyright') OR contains(lower(text), 'license')) AND (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND len(regexp_extract_all(text, '\\d+[.,]\\d+|\\d+')) >= 5")
def _(spark, d):
    own = pages(spark, d)
    return own.where(P.is_data_page(F.col("text"), words=["the", "der"], skip=["copyright", "license"])).select("page_num")


@query("p5_prefilter_pages", f"WITH {PAGES} SELECT page_num FROM pages_in WHERE (contains(lower(text), 'the') AND len(regexp_extract_all(text, '\\d+[.,]\\d+')) >= 5) OR (regexp_matches(text, '[A-ZА-ЯЁ]{{2,6}}[\\s\\-]?\\d{{1,3}}[\\s\\-/]\\d{{1,3}}') AND len(regexp_extract_all(text, '\\d+[.,]\\d+')) >= 10)")
def _(spark, d):
    decimals = P.matches(F.col("text"), r"\d+[.,]\d+")
    has = (P.keyword_score(F.col("text"), ["the"]) > 0) & (decimals >= 5)
    return pages(spark, d).where(has | (F.col("text").rlike(P.MODEL_NAME) & (decimals >= 10))).select("page_num")


@query("p6_quick_check", f"WITH {PAGES}, x AS (SELECT page_num, substr(text, 1, 1500) AS t FROM pages_in WHERE length(text) >= 50) SELECT page_num, CASE WHEN contains(t, 'The') AND contains(t, 'und') THEN 'mixed' WHEN len(regexp_extract_all(t, '\\d+')) > 10 AND contains(t, 'the') THEN 'numeric' ELSE 'none' END AS kind FROM x")
def _(spark, d):
    t = F.substring("text", 1, 1500)
    kind = F.when(t.contains("The") & t.contains("und"), "mixed").when((P.matches(t, r"\d+") > 10) & t.contains("the"), "numeric").otherwise("none")
    return pages(spark, d).where(F.length("text") >= 50).select("page_num", kind.alias("kind"))


@query("p7_short_page_skip", f"WITH {PAGES} SELECT page_num, length(text) AS n FROM pages_in WHERE length(trim(text)) >= 50")
def _(spark, d):
    return pages(spark, d).where(F.length(F.trim("text")) >= 50).select("page_num", F.length("text").cast("long").alias("n"))


@query("p8_numbers_in_text", f"WITH {PAGES} SELECT page_num, len(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+[.,]?[0-9]*'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)))) AS n FROM pages_in")
def _(spark, d):
    return pages(spark, d).select("page_num", F.size(numbers_in(F.col("text"))).cast("long").alias("n"))


@query("s3_scanned_flag", f"WITH {PAGES} SELECT source_file, avg(CASE WHEN length(trim(text)) > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.10::DOUBLE AS scanned FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page_num) AS r FROM pages_in) WHERE r <= 20 GROUP BY source_file")
def _(spark, d):
    return P.is_scanned(pages(spark, d))


@query("s5_page_range", f"WITH {PAGES} SELECT page_num FROM pages_in WHERE page_num + 1 BETWEEN 1 AND 10 OR page_num + 1 = 15 OR page_num + 1 BETWEEN 20 AND 250")
def _(spark, d):
    return pages(spark, d).where(P.page_range("1-10,15,20-250", F.col("page_num"))).select("page_num")


@query("p12_split_text_table", f"WITH {PAGES}, l AS (SELECT page_num, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS i FROM pages_in), p AS (SELECT page_num, i, str_split(trim(line), ' | ') AS parts FROM l), k AS (SELECT *, count(*) OVER (PARTITION BY page_num) AS n FROM p WHERE len(parts) >= 3) SELECT page_num, CAST(sum(len(parts)) AS BIGINT) AS n_cells FROM k WHERE n >= 3 GROUP BY page_num")
def _(spark, d):
    # the pages mark columns by ' | ', which counts as two blanks
    own = pages(spark, d).select("page_num", F.replace("text", F.lit(" | "), F.lit("   ")).alias("text"))
    return P.text_table(own).groupBy("page_num").agg(F.count("*").alias("n_cells"))


@query("p25_dominant_value", f"WITH {PAGES}, l AS (SELECT page_num, regexp_extract(unnest(str_split(text, chr(10))), '^([A-Z][a-z]+)', 1) AS v FROM pages_in), c AS (SELECT page_num, v, count(*) AS n FROM l WHERE v <> '' GROUP BY ALL) SELECT page_num, v AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY n DESC, v) AS r FROM c) WHERE r = 1")
def _(spark, d):
    return P.dominant(pages(spark, d), "^([A-Z][a-z]+)", ["page_num"])


@query("p13_lines_to_blocks", f"WITH {PAGES}, l AS (SELECT page_num, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS line_no FROM pages_in), y AS (SELECT *, line_no * 12.0::DOUBLE + CASE WHEN line_no % 4 = 3 THEN 40 ELSE 0 END AS y, 10.0::DOUBLE AS font_size FROM l), g AS (SELECT *, CASE WHEN coalesce(y - lag(y) OVER (PARTITION BY page_num ORDER BY line_no) > 20.0::DOUBLE, true) THEN 1 ELSE 0 END AS nw FROM y), k AS (SELECT *, sum(nw) OVER (PARTITION BY page_num ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS b FROM g) SELECT page_num, CAST(b AS BIGINT) AS block_no, CAST(min(line_no) AS INTEGER) AS first_line, count(*) AS n_lines FROM k GROUP BY ALL")
def _(spark, d):
    y = F.col("line_no") * 12.0 + F.when(F.col("line_no") % 4 == 3, 40).otherwise(0)
    own = P.lines(pages(spark, d).select("page_num", "text")).withColumns({"y": y, "font_size": F.lit(10.0)})
    return P.blocks(own, ["page_num"]).select("page_num", "block_no", "first_line", "n_lines")


@query("p15_detect_rpm", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN 700 + event_id % 3000 BETWEEN 800 AND 3600 THEN CAST(700 + event_id % 3000 AS INTEGER) ELSE 0 END WHEN event_id % 5 = 1 THEN 1450 WHEN event_id % 5 = 2 THEN 2900 WHEN event_id % 5 = 3 THEN 3500 ELSE 0 END AS rpm FROM events")
def _(spark, d):
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(F.lit("pump n = "), (700 + F.col("event_id") % 3000).cast("string"), F.lit(" rpm x"))).when(k == 1, "at 50 Hz").when(k == 2, "at 50 Hz, 2-pole").when(k == 3, "60 Hz").otherwise("none")
    return table(spark, d, "events").select("event_id", P.detect_rpm(text).alias("rpm"))


@query("p9_nominal_records", "SELECT l_orderkey, l_partkey, l_linenumber, concat('CMI ', (l_partkey % 90 + 1)::varchar, '-', l_linenumber::varchar) AS model, CAST(floor(l_quantity) AS DOUBLE) AS q, floor(l_extendedprice / 100) / 10 AS h FROM lineitem")
def _(spark, d):
    line = table(spark, d, "lineitem")
    model = F.concat(F.lit("CMI "), (F.col("l_partkey") % 90 + 1).cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    h = (F.floor(F.col("l_extendedprice") / 100) / 10).cast("decimal(12,1)").cast("string")
    text = F.concat(F.lit("Head\n"), model, F.lit("  12345678 "), F.floor("l_quantity").cast("string"), F.lit(",0 "), h, F.lit(" 0,55\n"))
    # rows of lineitem may repeat their keys, so each match is counted on its own
    return P.records(line.select("l_orderkey", "l_partkey", "l_linenumber", text.alias("text")), P.NOMINAL, ["model", "article", "q", "h", "p"]).select("l_orderkey", "l_partkey", "l_linenumber", F.trim("model").alias("model"), P.parse_number(F.col("q")).alias("q"), P.parse_number(F.col("h")).alias("h"))


@query("p27_text_line_records", "SELECT p_partkey, 'Abcd' AS model, p_size::DOUBLE AS q, p_size * 1.5::DOUBLE AS h, 20.0::DOUBLE AS p FROM part")
def _(spark, d):
    text = F.concat(F.lit("intro\nAbcd "), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_size") * 1.5).cast("decimal(8,1)").cast("string"), F.lit(" 20 1,5\nend 1 2"))
    return P.line_records(table(spark, d, "part").select("p_partkey", text.alias("text"))).select("p_partkey", "model", "q", "h", "p")


@query("p11_inline_kv_records", "SELECT p_partkey, p_size::DOUBLE AS q, 14.5::DOUBLE AS h, CASE WHEN p_size % 2 = 0 THEN 0.75::DOUBLE END AS p FROM part")
def _(spark, d):
    text = F.concat(F.lit("TD Q="), F.col("p_size").cast("string"), F.lit(" m3/h, H=14,5 m"), F.when(F.col("p_size") % 2 == 0, ", P=0.75 kW").otherwise(""))
    return table(spark, d, "part").select("p_partkey", P.inline_records(text, F.lit("TD")).alias("r")).select("p_partkey", "r.q", "r.h", "r.p")


@query("p20_brand_for_series", "SELECT p_partkey, CASE substr(p_type, 1, 2) WHEN 'EC' THEN 'Alpha' WHEN 'PR' THEN 'Beta' ELSE 'Unknown' END AS brand FROM part")
def _(spark, d):
    brands = F.create_map(*map(F.lit, ("EC", "Alpha", "PR", "Beta")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(brands[F.substring("p_type", 1, 2)], F.lit("Unknown")).alias("brand"))


RULES = [("Ond", "text", "the of", 1), ("Berk", "domain", "keit", 2), ("Cion", "text3", "ción", 1), ("File", "filename", "src7", 3), ("Ander", "text", "ander", 1)]
TEXT_BRANDS = f"""w AS (SELECT source_file, lower(string_agg(text, ' ' ORDER BY page_num)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page_num) AS r FROM pages_in) WHERE r <= 10 GROUP BY source_file),
rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) v(brand, kind, marker, priority)),
h AS (SELECT source_file, brand, kind, priority, CASE WHEN kind = 'domain' AND contains(t, marker) THEN 0.95::DOUBLE WHEN kind = 'text' AND contains(t, marker) THEN 0.9::DOUBLE WHEN kind = 'text3' AND len(str_split(t, marker)) > 3 THEN 0.85::DOUBLE WHEN kind = 'filename' AND contains(source_file, marker) THEN 0.8::DOUBLE END AS c FROM w, rules),
tb AS (SELECT source_file, brand, c AS confidence, kind FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY c DESC, priority, brand) AS r FROM h WHERE c IS NOT NULL) WHERE r = 1)"""


@query("p17_brand_from_text", f"WITH {PAGES}, {TEXT_BRANDS} SELECT * FROM tb")
def _(spark, d):
    rules = spark.createDataFrame(RULES, "brand string, kind string, marker string, priority int")
    return P.brand_of_text(pages(spark, d), rules)


PREFIX_BRANDS = [("EC", "Alpha"), ("ST", "Beta"), ("STA", "Beta"), ("P", "Gamma")]
MODEL_BRANDS = f"""mp AS (SELECT * FROM (VALUES {", ".join(str(r) for r in PREFIX_BRANDS)}) v(prefix, brand)),
mh AS (SELECT p_brand, brand, count(*) AS hits FROM part JOIN mp ON starts_with(upper(p_type), prefix) GROUP BY ALL), mn AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
mb AS (SELECT p_brand, brand, least(0.95::DOUBLE, 0.5::DOUBLE + hits / n * 0.45::DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY hits DESC, brand) AS r FROM mh) JOIN mn USING (p_brand) WHERE r = 1)"""


@query("p18_brand_from_models", f"WITH {MODEL_BRANDS} SELECT * FROM mb")
def _(spark, d):
    return P.brand_of_models(table(spark, d, "part"), spark.createDataFrame(PREFIX_BRANDS, "prefix string, brand string"), "p_brand", "p_type")


@query("p19_brand_resolve", f"WITH {MODEL_BRANDS}, t AS (SELECT p_brand, min(CASE WHEN p_size < 10 THEN 'Alpha' WHEN p_size < 15 THEN 'Beta' END) AS brand, 0.9::DOUBLE AS confidence FROM part GROUP BY 1 HAVING count(*) % 2 = 0) SELECT p_brand, coalesce(t.brand, mb.brand, 'Unknown') AS brand, CASE WHEN t.brand = mb.brand THEN least(1.0::DOUBLE, t.confidence + 0.05::DOUBLE) ELSE coalesce(t.confidence, mb.confidence, 0.0::DOUBLE) END AS confidence, CASE WHEN t.brand = mb.brand THEN 'combined' WHEN t.brand IS NOT NULL THEN 'text' WHEN mb.brand IS NOT NULL THEN 'models' ELSE '' END AS source FROM t FULL JOIN mb USING (p_brand)")
def _(spark, d):
    part = table(spark, d, "part")
    text = part.groupBy("p_brand").agg(F.min(F.when(F.col("p_size") < 10, "Alpha").when(F.col("p_size") < 15, "Beta")).alias("brand"), F.count("*").alias("n")).where("n % 2 = 0").select("p_brand", "brand", F.lit(0.9).alias("confidence"))
    return P.brand_resolved(text, P.brand_of_models(part, spark.createDataFrame(PREFIX_BRANDS, "prefix string, brand string"), "p_brand", "p_type"), "p_brand")


@query("p21_rebrand", f"WITH {MODEL_BRANDS} SELECT brand, count(*) AS n_models, count(*) FILTER (p_brand <> brand) AS n_changed FROM part JOIN mb USING (p_brand) GROUP BY brand")
def _(spark, d):
    part = table(spark, d, "part")
    brands = P.brand_of_models(part, spark.createDataFrame(PREFIX_BRANDS, "prefix string, brand string"), "p_brand", "p_type").select("p_brand", "brand")
    return part.join(brands, "p_brand").groupBy("brand").agg(F.count("*").alias("n_models"), F.count_if(F.col("p_brand") != F.col("brand")).alias("n_changed"))


@query("p22_catalog_type", "SELECT p_partkey, CASE WHEN contains(p_type, 'COPPER') THEN 'CDM' WHEN contains(p_type, 'STEEL') THEN 'CMI' WHEN contains(p_type, 'TIN') THEN 'NBS' ELSE 'UNKNOWN' END AS kind FROM part")
def _(spark, d):
    kind = F.when(F.col("p_type").contains("COPPER"), "CDM").when(F.col("p_type").contains("STEEL"), "CMI").when(F.col("p_type").contains("TIN"), "NBS").otherwise("UNKNOWN")
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query("p23_clean_catalog_name", r"SELECT p_partkey, substr(upper(trim(regexp_replace(regexp_replace(concat(p_name, '_', p_brand), '[\s_\-]*\d{6,8}$', ''), '[^A-Za-z0-9]+', ' ', 'g'))), 1, 50) AS name FROM part")
def _(spark, d):
    raw = F.concat(F.lit("Katalog-"), "p_name", F.lit("_"), "p_brand", F.lit("_20241125.pdf"))
    return table(spark, d, "part").select("p_partkey", P.clean_catalog_name(raw).alias("name"))


@query("p24_signatures", f"WITH {PAGES} SELECT page_num, array_to_string(list_filter([regexp_extract(text, '(Th[a-z]+)', 1), regexp_extract(text, '(D[a-z]+)', 1), regexp_extract(text, '([0-9]+)', 1)], lambda x: x <> ''), ',') AS signatures FROM pages_in")
def _(spark, d):
    found = F.array(*(F.regexp_extract("text", p, 1) for p in ("(Th[a-z]+)", "(D[a-z]+)", "([0-9]+)")))
    return pages(spark, d).select("page_num", F.concat_ws(",", F.filter(found, lambda x: x != "")).alias("signatures"))


@query("p26_normalise_text", f"WITH {PAGES} SELECT page_num, md5(regexp_replace(regexp_replace(translate(text, '–—‒−', '----'), '(\\d)\\s+([.,]\\d)', '\\1\\2', 'g'), '(\\d)\\s+-\\s*(\\d)', '\\1-\\2', 'g')) AS digest FROM pages_in")
def _(spark, d):
    return pages(spark, d).select("page_num", F.md5(P.normalise_text(F.col("text"))).alias("digest"))


@query("p16_manufacturer", f"WITH {PAGES}, c AS (SELECT source_file, CAST(sum(len(str_split(lower(text), 'keit')) - 1) AS BIGINT) AS a, CAST(sum(len(str_split(lower(text), 'ción')) - 1) AS BIGINT) AS b FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page_num) AS r FROM pages_in) WHERE r <= 5 GROUP BY source_file) SELECT source_file, CASE WHEN contains(source_file, 'src7') THEN 'File' WHEN a = 0 AND b = 0 THEN 'Unknown' WHEN a >= b THEN 'Keit' ELSE 'Cion' END AS maker FROM c")
def _(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("source_file").orderBy("page_num")
    some = pages(spark, d).withColumn("r", F.row_number().over(order)).where("r <= 5")
    count = lambda w: F.sum(F.size(F.split(F.lower("text"), w)) - 1)
    c = some.groupBy("source_file").agg(count("keit").alias("a"), count("ción").alias("b"))
    return c.select("source_file", F.when(F.col("source_file").contains("src7"), "File").when((F.col("a") == 0) & (F.col("b") == 0), "Unknown").when(F.col("a") >= F.col("b"), "Keit").otherwise("Cion").alias("maker"))


@query("j14_ground_in_page", f"WITH {PAGES}, x AS (SELECT page_num, text, CASE WHEN page_num % 2 = 0 THEN 'The' ELSE 'zzz 9' END AS model, CAST(page_num % 40 AS DOUBLE) AS q, list_transform(regexp_extract_all(text, '[0-9]+[.,]?[0-9]*'), lambda n: TRY_CAST(replace(n, ',', '.') AS DOUBLE)) AS ns FROM pages_in), y AS (SELECT *, contains(upper(text), upper(model)) OR contains(replace(upper(text), ' ', ''), replace(upper(model), ' ', '')) OR (length(str_split(upper(model), ' ')[1]) >= 3 AND contains(upper(text), str_split(upper(model), ' ')[1])) AS named, q > 0 AND len(list_filter(ns, lambda n: n > 0 AND abs(n - q) / greatest(q, 0.01::DOUBLE) <= 0.05::DOUBLE)) > 0 AS found FROM x) SELECT page_num, CASE WHEN named THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN q > 0 AND NOT found THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM y")
def _(spark, d):
    model = F.when(F.col("page_num") % 2 == 0, "The").otherwise("zzz 9")
    return pages(spark, d).select("page_num", P.grounded(model, [(F.col("page_num") % 40).cast("double")], F.col("text")).alias("factor"))


@query("j17_recipe_match", f"WITH {PAGES}, w AS (SELECT source_file, lower(string_agg(text, ' ' ORDER BY page_num)) AS t FROM pages_in GROUP BY source_file), r AS (SELECT * FROM (VALUES ('r1', 'src1%', 'keit', 0.9, 0), ('r2', 'src2%', 'ción', 0.5, 2), ('r3', 'none', 'the', 0.7, 0)) v(recipe_id, pat, kw, confidence, failures)), s AS (SELECT source_file, recipe_id, (CASE WHEN source_file LIKE pat THEN 100 ELSE 0 END + CASE WHEN contains(t, kw) THEN 50 ELSE 0 END) * CASE WHEN failures >= 3 THEN 0.3::DOUBLE WHEN failures >= 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * (0.5::DOUBLE + confidence::DOUBLE * 0.5::DOUBLE) AS score FROM w, r) SELECT source_file, recipe_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, recipe_id) AS k FROM s WHERE score >= 40) WHERE k = 1")
def _(spark, d):
    own = [("r1", "src1*", ["keit"], [], 0.9, 0), ("r2", "src2*", ["ción"], [], 0.5, 2), ("r3", "none", ["the"], [], 0.7, 0)]
    rows = spark.createDataFrame(own, "recipe_id string, file_pattern string, keywords array<string>, signatures array<string>, confidence double, failures int")
    return recipes.match(pages(spark, d), rows, least=40.0)


PRODUCERS = """rp AS (SELECT * FROM (VALUES ('a', 'src?', ['zzzz'], ['ción', 'and'], 'keit', 0.8, 1), ('b', '*7', ['the', 'the'], NULL, 'nobody', 0.9, 3), ('c', '*', [''], ['und'], NULL, 0.1, 0)) v(recipe_id, pat, kws, sigs, producer, confidence, failures))"""


@query(
    "j17_recipe_match_producer",
    f"""WITH {PAGES}, {PRODUCERS}, t AS (SELECT DISTINCT source_file, recipe_id, pat, kws, sigs, producer, confidence, failures FROM pages_in, rp),
    h AS (SELECT t.*, x.w AS w, x.pts AS pts, EXISTS (SELECT 1 FROM pages_in p WHERE p.source_file = t.source_file AND contains(lower(p.text), x.w)) AS hit FROM t, (SELECT recipe_id AS r, unnest(kws) AS w, 50 AS pts FROM rp UNION ALL SELECT recipe_id, unnest(sigs), 30 FROM rp UNION ALL SELECT recipe_id, producer, 20 FROM rp) x WHERE x.r = t.recipe_id AND x.w <> ''),
    s AS (SELECT t.source_file, t.recipe_id, (coalesce((SELECT sum(pts) FROM h WHERE hit AND h.source_file = t.source_file AND h.recipe_id = t.recipe_id), 0) + CASE WHEN regexp_full_match(t.source_file, replace(replace(pat, '*', '.*'), '?', '.')) THEN 100 ELSE 0 END) * CASE WHEN failures >= 3 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * (0.5::DOUBLE + confidence::DOUBLE * 0.5::DOUBLE) AS score FROM t)
    SELECT source_file, recipe_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, recipe_id) AS k FROM s WHERE score >= 30) WHERE k = 1""",
)
def _(spark, d):
    own = [("a", "src?", ["zzzz"], ["ción", "and"], "keit", 0.8, 1), ("b", "*7", ["the", "the"], None, "nobody", 0.9, 3), ("c", "*", [""], ["und"], None, 0.1, 0)]
    rows = spark.createDataFrame(own, "recipe_id string, file_pattern string, keywords array<string>, signatures array<string>, producer string, confidence double, failures int")
    return recipes.match(pages(spark, d), rows, least=30.0)


@query("q14_page_worklist", f"WITH {PAGES} SELECT source_file, page_num, CASE WHEN regexp_matches(text, '[0-9]') AND contains(text, ' | ') THEN 'validate' WHEN contains(text, ' | ') THEN 'extract' END AS task FROM pages_in WHERE contains(text, ' | ')")
def _(spark, d):
    t = F.col("text")
    return pages(spark, d).where(t.contains(" | ")).select("source_file", "page_num", F.when(t.rlike("[0-9]"), "validate").otherwise("extract").alias("task"))
