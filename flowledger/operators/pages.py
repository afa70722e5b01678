"""Page texts: classification, records in lines, brands, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound, once
from ..functions.numbers import numbers_in, parse_number
from .wordscan import words_in

# Keywords of page types.
SKIP = [
    "габаритные размеры", "dimensional drawing", "dimensions and", "maße", "dimensioni", "dimensions et poids", "dimensiones", "overall dimensions", "outline dimensions",
    "инструкция по", "installation", "montage", "installazione", "руководство по эксплуатации", "operating instructions", "instructions de", "istruzioni",
    "материалы конструкции", "material description", "werkstoff", "materiali", "matériaux", "взрыв-схема", "exploded view", "explosionszeichnung", "vista esplosa",
    "гарантийные", "warranty", "garantie", "garanzia", "условия заказа", "ordering", "bestellung", "commande", "упаковка", "packaging",
]
DATA = [
    "qном", "hном", "qном.", "hном.", "номинальный расход", "номинальный напор", "подача", "напор", "мощность p2", "мощность, квт", "артикул", "q=delivery", "technical data",
    "performance data", "pump data", "rated flow", "rated head", "nominal flow", "nominal head", "delivery/caudal", "débit/подача", "м³/ч", "m³/h", "m3/h", "l/min", "gpm",
]
GRAPH = ["q-h", "h-q", "performance curve", "характеристик", "кривая", "рабочая точка", "working point", "kennlinie", "courbe", "curva"]
COVER = ["каталог продукции", "product catalog", "produktkatalog", "catalogue", "catalogo", "серия насосов", "pump series", "модельный ряд"]
CONTENTS = ["содержание", "содержание:", "table of contents", "contents", "inhaltsverzeichnis", "sommaire", "indice"]
MODEL_CODE = ["расшифровка обозначения", "расшифровка модели", "model designation", "type key", "typenschlüssel", "обозначение модели", "код модели", "model code"]
MODEL_RANGE = ["рабочее поле", "selection chart", "auswahldiagramm", "campo di lavoro", "диапазон применения", "application range", "рабочий диапазон", "operating range"]
# Patterns.
MODEL_NAME = r"[A-ZА-ЯЁ]{2,6}[\s\-]?\d{1,3}[\s\-/]\d{1,3}"
NUMERIC_ROW = r"(?:[\d]+[.,]?\d*\s+){3,}[\d]+[.,]?\d*"
Q_HEADER = r"(?iu)Q\s*[\(\[]?\s*(?:м[³3]/ч|m[³3]/h|m3/h|l/min|gpm|л/мин)"
UNIT_WORD = r"(?iu)(?:м³/ч|m³/h|m3/h|квт|kw|hp|об/мин|rpm|л/с|l/s|gpm)"
DATA_TYPES = ["data_table", "model_range", "data_graph"]


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """How many different keywords a text has, in any case."""
    return bound(F.lower(text), lambda low: sum((F.contains(low, F.lit(k)).cast("int") for k in dict.fromkeys(k.lower() for k in keywords)), F.lit(0)))


def matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def classify(pages: DataFrame, text: str = "text", page: str = "page_num", tables: Column | None = None, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """pages with page_type and type_confidence. keywords: other lists than the fixed ones, by name (skip, data, graph, cover,
    contents, model_code, model_range). tables: number of tables found on the page. Null text counts as empty."""
    own = {"skip": SKIP, "data": DATA, "graph": GRAPH, "cover": COVER, "contents": CONTENTS, "model_code": MODEL_CODE, "model_range": MODEL_RANGE} | (keywords or {})
    body = F.coalesce(F.col(text), F.lit(""))
    tables = F.lit(0) if tables is None else F.coalesce(tables, F.lit(0))
    marks = {"_models": matches(body, MODEL_NAME), "_rows": matches(body, NUMERIC_ROW), "_header": body.rlike(Q_HEADER), "_units": body.rlike(UNIT_WORD)}
    # what a page's text tells, once for each page however often a filter on the type asks for it
    told = lambda low: F.struct(*(x.alias(name) for name, x in ({f"_{k}": keyword_score(low, words) for k, words in own.items()} | {"_low": low} | marks).items()))
    out = once(pages, bound(F.lower(F.trim(body)), told), pages.columns)
    c = F.col
    data = c("_data") + F.when(c("_models") >= 3, 3).when(c("_models") >= 1, 1).otherwise(0) + F.when(c("_rows") >= 3, 2).otherwise(0) + F.when(tables >= 1, 2).otherwise(0) + F.when(c("_header"), 2).otherwise(0) + F.when(c("_units"), 1).otherwise(0)
    named = lambda a, b: F.contains(c("_low"), F.lit(a)) | F.contains(c("_low"), F.lit(b))
    dimensions, installation, materials = named("габарит", "dimension"), named("инструкция", "installation"), named("материал", "material")
    scores = {
        "dimensions": F.when(dimensions, c("_skip")).otherwise(0),
        "installation": F.when(installation, c("_skip")).otherwise(0),
        "materials": F.when(materials, c("_skip")).otherwise(0),
        "data_table": data,
        "data_graph": c("_graph") + F.when(c("_header") & (tables == 0), 2).otherwise(0),
        "cover": c("_cover") + F.when(F.col(page) == 0, 2).otherwise(0),
        "toc": c("_contents"),
        "model_code": c("_model_code"),
        "model_range": c("_model_range"),
    }
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("type")) for i, (name, s) in enumerate(scores.items()))))
    out = out.withColumn("_best", best)
    score, kind = c("_best.score"), c("_best.type")
    skipped = (c("_skip") >= 2) & ~kind.isin("data_table", "data_graph")
    kind = F.when(skipped & dimensions, "dimensions").when(skipped & installation, "installation").when(skipped & materials, "materials").otherwise(kind)
    dense = (score <= 1) & (c("_rows") >= 5) & (c("_models") >= 2)
    kind = F.when(dense, "data_table").when((score <= 1) & (F.col(page) == 0), "cover").when(score <= 1, "other").otherwise(kind)
    score = F.when(dense, 3).otherwise(score)
    short = F.length(c("_low")) < 30
    out = out.withColumns({
        "page_type": F.when(short, F.when(F.col(page) < 3, "cover").otherwise("other")).otherwise(kind),
        "type_confidence": F.when(short, 0.5).otherwise(F.least(F.lit(0.95), F.lit(0.5) + score * 0.1)),
    })
    return out.drop(*(f"_{k}" for k in own), "_low", "_models", "_rows", "_header", "_units", "_best")


# Words and marks of pages with pump data, and of pages to pass over.
PUMP_WORDS = ["подача", "расход", "напор", "мощность", "насос", "flow", "head", "power", "pump", "impeller", "capacity", "förderstrom", "förderhöhe", "leistung", "pumpe", "portata", "prevalenza", "potenza", "pompa"]
CONTEXT = r"(?iU)\b[QH]\s*[\[\(=:]|\b[QHP]\s*\d|\brpm\b|\bm³/h\b|\bм³/ч\b|\bl/s\b|\bl/min\b|\bgpm\b"
PASS_OVER = ["contents", "table of contents", "содержание", "warranty", "гарантия", "installation guide", "руководство по монтажу", "copyright", "all rights reserved"]


def is_data_page(text: Column, words: list[str] = PUMP_WORDS, skip: list[str] = PASS_OVER, least_numbers: int = 5) -> Column:
    """A pump word or a marked value, five numbers, and no word that tells of another kind of page."""
    numbers = matches(text, r"\d+[.,]\d+|\d+")
    found = (keyword_score(text, words) > 0) | text.rlike(CONTEXT)
    return F.coalesce((keyword_score(text, skip) == 0) & found & (numbers >= least_numbers), F.lit(False))


def is_scanned(pages: DataFrame, by: str = "source_file", page: str = "page_num", text: str = "text", first: int = 20) -> DataFrame:
    """by, scanned: less than a tenth of the first pages have over 50 characters."""
    order = Window.partitionBy(by).orderBy(page)
    some = pages.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= first)
    return some.groupBy(by).agg((F.avg((F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 50).cast("double")) < 0.10).alias("scanned"))


def page_range(spec: str, page: Column) -> Column:
    """'1-10,15,20-25' (from 1) as a filter on a page number from 0; an empty spec takes all pages."""
    out = None
    for part in filter(None, (x.strip() for x in spec.split(","))):
        low, _, high = part.partition("-")
        one = (page + 1).between(int(low), int(high or low))
        out = one if out is None else out | one
    return F.lit(True) if out is None else out


def lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, with line_no from 0."""
    return pages.select(*(x for x in pages.columns if x != text), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def text_table(pages: DataFrame, text: str = "text", least_parts: int = 3, least_lines: int = 3) -> DataFrame:
    """Cells of lines that fall into three parts or more at two blanks or more: row_no (0: header) and col_no; pages with
    fewer than three such lines have none."""
    keys = [x for x in pages.columns if x != text]
    cut = lines(pages, text).withColumn("parts", F.split(F.trim("line"), r"\s{2,}")).where(F.size("parts") >= least_parts)
    order = Window.partitionBy(*keys)
    rows = cut.withColumns({"row_no": F.row_number().over(order.orderBy("line_no")) - 1, "_n": F.count("*").over(order)}).where(F.col("_n") >= least_lines)
    return rows.select(*keys, "row_no", F.posexplode("parts").alias("col_no", "text"))


# Shapes of records in lines.
NOMINAL = r"([A-ZА-ЯЁ][A-ZА-ЯЁa-zа-яё]{1,5}[\s\-_][\d][\d/\-_.a-zA-Z()\s]{1,40}?)\s+(\d{6,9})\s+([\d,.]+)\s+([\d,.]+)\s+([\d,.]+)"
LINE = r"^([A-ZА-Я][A-Za-zА-Яа-я\d\-/. ]{3,40}?)\s+([\d,.]+)\s+([\d,.]+)\s+([\d,.]+)"


def records(pages: DataFrame, pattern: str, fields: list[str], text: str = "text") -> DataFrame:
    """A row for each match of a pattern in a page: place and its groups by name. A template is a pattern with its fields."""
    keys = [x for x in pages.columns if x != text]
    groups = F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i + 1)).alias(name) for i, name in enumerate(fields)))
    return pages.select(*keys, F.posexplode(groups).alias("place", "g")).select(*keys, "place", *(F.col(f"g.{x}").alias(x) for x in fields))


def nominal_records(pages: DataFrame, text: str = "text") -> DataFrame:
    """Model, article, flow, head and power lines; each (model, article) of a page once, the first."""
    keys = [x for x in pages.columns if x != text]
    found = records(pages, NOMINAL, ["model", "article", "q", "h", "p"], text)
    found = found.withColumns({"model": F.trim(F.regexp_replace("model", r"\s+", " "))} | {x: parse_number(F.col(x)) for x in "qhp"}).where("q IS NOT NULL AND h IS NOT NULL")
    return found.groupBy(*keys, "model", "article").agg(F.min(F.struct("place", "q", "h", "p")).alias("r")).select(*keys, "model", "article", "r.q", "r.h", "r.p")


def line_records(pages: DataFrame, text: str = "text") -> DataFrame:
    """Lines with a name and three numbers in the ranges of flow, head and power."""
    own = lines(pages, text).withColumn("line", F.trim("line"))
    part = lambda i: F.regexp_extract("line", LINE, i)
    own = own.where(F.col("line").rlike(LINE)).select(*(x for x in own.columns if x != "line"), F.trim(part(1)).alias("model"), parse_number(part(2)).alias("q"), parse_number(part(3)).alias("h"), parse_number(part(4)).alias("p"))
    return own.where(F.col("q").between(0.1, 10000) & F.col("h").between(0, 3000) & F.col("p").between(0.01, 2000))


def inline_records(text: Column, model: Column) -> Column:
    """struct(model, q, h, p) of 'Q=.. H=.. P=..' on a line; null without flow and head."""
    value = lambda letter, unit: parse_number(F.regexp_extract(text, rf"(?i){letter}\s*[=:]\s*([\d,.]+?)[,.]?\s*(?:{unit}|\s|$)", 1))
    q, h, p = value("Q", "м[³3]/ч|m[³3]/h"), value("H", "м|m"), value("P", "кВт|kW")
    return F.when((F.length(model) > 0) & q.isNotNull() & h.isNotNull(), F.struct(model.alias("model"), q.alias("q"), h.alias("h"), p.alias("p")))


def detect_rpm(text: Column) -> Column:
    """A speed from 800 to 3600 in 'n=.. rpm', else in '.... rpm', else by the mains frequency; 0 without any."""
    one = F.regexp_extract(text, r"(?iu)n\s*[=:]\s*(\d{3,4})\s*(?:rpm|об/мин|l/min|min|1/min)", 1).try_cast("int")
    two = F.regexp_extract(text, r"(?iu)(\d{4})\s*(?:rpm|об/мин)", 1).try_cast("int")
    hertz = F.regexp_extract(text, r"(?i)(\d{2})\s*Hz", 1).try_cast("int")
    fits = lambda x: F.when(x.between(800, 3600), x)
    two_poles = F.contains(text, F.lit("2900")) | F.contains(text, F.lit("2950")) | F.contains(text, F.lit("2-pole"))
    return F.coalesce(fits(one), fits(two), F.when(hertz == 50, F.when(two_poles, 2900).otherwise(1450)).when(hertz == 60, 3500), F.lit(0))


def brand_of_text(pages: DataFrame, rules: DataFrame, by: str = "source_file", page: str = "page_num", text: str = "text", first: int = 10) -> DataFrame:
    """The brand of each catalogue by its first pages and its file name: brand, confidence, kind.

    rules: brand, kind (domain .95, text .9, text3 .85 for three hits or more, filename .8), marker, priority. An automaton of all
    markers reads each catalogue's joined first pages and its name once; rules meet the markers that were found in an equi join.
    The first brand by confidence, priority and name wins. Markers are bounded as words_in() says.
    """
    order = Window.partitionBy(by).orderBy(page)
    some = pages.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= first)
    whole = some.groupBy(by).agg(F.lower(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct(page, F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]))).alias("_text"))
    own = rules.withColumn("term", F.lower("marker"))
    in_text = words_in(whole, "_text", own.where("kind <> 'filename'").select("term")).join(own.where("kind <> 'filename'"), "term")
    in_name = words_in(whole.select(by, F.lower(by).alias("_text")), "_text", own.where("kind = 'filename'").select("term")).join(own.where("kind = 'filename'"), "term")
    conf = F.when(F.col("kind") == "domain", 0.95).when(F.col("kind") == "text", 0.9).when((F.col("kind") == "text3") & (F.col("hits") >= 3), 0.85).when(F.col("kind") == "filename", 0.8)
    found = in_text.unionByName(in_name).select(by, "brand", "kind", "priority", conf.alias("confidence")).where("confidence IS NOT NULL")
    best = found.groupBy(by).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "priority", "brand", "kind")).alias("b"))
    return best.select(by, "b.brand", (-F.col("b.c")).alias("confidence"), "b.kind")


def brand_of_models(models: DataFrame, prefixes: DataFrame, by: str, model: str, most: int = 6) -> DataFrame:
    """The brand whose series prefixes start most of the models: brand, confidence min(.95, .5 + .45 * hits / n).

    Models are dealt out by their prefixes (most letters at most), so the rules are an equi join.
    """
    own = models.select(by, F.upper(F.trim(model)).alias("_name")).where("_name <> ''")
    sizes = own.groupBy(by).agg(F.count("*").alias("n"))
    dealt = own.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("_name"), F.lit(most))), lambda k: F.substring(F.col("_name"), F.lit(1), k))))
    hits = dealt.join(prefixes, "prefix").groupBy(by, "brand").agg(F.count("*").alias("hits"))
    best = hits.groupBy(by).agg(F.min(F.struct((-F.col("hits")).alias("h"), "brand")).alias("b"))
    return best.join(sizes, by).select(by, "b.brand", F.least(F.lit(0.95), F.lit(0.5) - F.col("b.h") / F.col("n") * 0.45).alias("confidence"))


def brand_resolved(by_text: DataFrame, by_models: DataFrame, by: str) -> DataFrame:
    """The text's brand, surer by .05 if the models agree; else the models' brand; else Unknown."""
    both = by_text.select(by, F.col("brand").alias("tb"), F.col("confidence").alias("tc")).join(by_models.select(by, F.col("brand").alias("mb"), F.col("confidence").alias("mc")), by, "full")
    agree = F.col("tb") == F.col("mb")
    return both.select(
        by,
        F.coalesce("tb", "mb", F.lit("Unknown")).alias("brand"),
        F.when(agree, F.least(F.lit(1.0), F.col("tc") + 0.05)).otherwise(F.coalesce("tc", "mc", F.lit(0.0))).alias("confidence"),
        F.when(agree, "combined").when(F.col("tb").isNotNull(), "text").when(F.col("mb").isNotNull(), "models").otherwise("").alias("source"),
    )


def dominant(pages: DataFrame, pattern: str, by: list[str], text: str = "text") -> DataFrame:
    """The most frequent first group of a pattern over a page's lines, the smallest among equals."""
    found = lines(pages, text).select(*by, F.regexp_extract("line", pattern, 1).alias("value")).where("value <> ''")
    counts = found.groupBy(*by, "value").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b")).select(*by, "b.value", (-F.col("b.m")).alias("n"))


def blocks(text_lines: DataFrame, by: list[str], gap: float = 2.0) -> DataFrame:
    """Lines (line_no, y, font_size) to blocks: a new one where y grows by over gap times the larger font of the two lines.
    block_no, first_line, n_lines, top, bottom (of the last line's y). Lines with x0 and line (their text) also give left, right
    (by half a font size a letter) and table_like: three lines at least, of which one has three columns between runs of two
    blanks, in at most two numbers of columns."""
    order = Window.partitionBy(*by).orderBy("line_no")
    font = F.greatest("font_size", F.lag("font_size").over(order))
    new = F.coalesce(F.col("y") - F.lag("y").over(order) > gap * font, F.lit(True))
    marked = text_lines.withColumn("_new", new.cast("int")).withColumn("block_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    more = []
    if {"x0", "line"} <= set(text_lines.columns):
        columns = F.size(F.split(F.trim("line"), r"\s{2,}"))
        like = (F.count("*") >= 3) & (F.countDistinct(columns) <= 2) & (F.max(columns) >= 3)
        more = [F.min("x0").alias("left"), F.max(F.col("x0") + F.length("line") * F.col("font_size") * 0.5).alias("right"), like.alias("table_like")]
    return marked.groupBy(*by, "block_no").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.min("y").alias("top"), F.max("y").alias("bottom"), *more)


def clean_catalog_name(name: Column) -> Column:
    """Without extension, 'catalogue' prefixes, dates and marks; upper case, at most 50 characters."""
    s = F.regexp_replace(name, r"(?i)\.pdf$", "")
    s = F.regexp_replace(s, r"(?iu)^(katalog|catalog|каталог)[\s_\-]*", "")
    s = F.regexp_replace(s, r"[\s_\-]*\d{6,8}$", "")
    s = F.regexp_replace(s, r"[^A-Za-zА-Яа-яЁё0-9]+", " ")
    return F.substring(F.upper(F.trim(s)), 1, 50)


def normalise_text(text: Column) -> Column:
    """Dashes to '-', blanks inside numbers and names off, the Cyrillic З before a digit to 3."""
    s = F.translate(text, "–—‒−", "----")
    s = F.regexp_replace(s, r"(\d)\s+([.,]\d)", "$1$2")
    s = F.regexp_replace(s, r"(\d)\s+-\s*(\d)", "$1-$2")
    return F.regexp_replace(s, r"З(?=\d)", "3")


def grounded(model: Column, values: list[Column], text: Column, tolerance: float = 0.05) -> Column:
    """The factor that confidence keeps when a record is looked up in its page: .5 without the model's name, .7 without any
    of two or more positive values, .7 + .3 * share when only some are found within a twentieth."""
    name, body = F.upper(F.trim(model)), F.upper(text)
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    head = F.split(name, r"[/(\s]")[0]
    named = (name != "") & (F.contains(body, name) | F.contains(bare(body), bare(name)) | ((F.length(head) >= 3) & F.contains(body, head)))
    numbers = numbers_in(text)

    def found_in(v: Column) -> Column:
        near = F.exists(numbers, lambda n: (n > 0) & (F.abs(n - v) / F.greatest(v, F.lit(0.01)) <= tolerance))
        return F.when(v > 0, near.cast("int"))

    found = [found_in(v) for v in values]
    hits, known = sum((F.coalesce(f, F.lit(0)) for f in found), F.lit(0)), sum((f.isNotNull().cast("int") for f in found), F.lit(0))
    by_name = F.when(named, 1.0).otherwise(0.5)
    by_value = F.when((known >= 2) & (hits == 0), 0.7).when((known > 0) & (hits < known), F.lit(0.7) + F.lit(0.3) * hits / known).otherwise(1.0)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 1.0).otherwise(by_name * by_value)


# Header words of lines that hold no flows, and the shape of a line with points.
Q_SKIP = ("Таблица", "Модель", "кВт", "Характеристик")
POINT_LINE = r"^(\d+[-−]\S+)\s+(\d+[.,]?\d*)\s+(.+)$"
LIST_LINE = r"(?m)(?:^\d+\s*[.)]\s*)?([A-ZА-ЯЁ][A-ZА-ЯЁa-zа-яё()]{1,10}[ \-_]?\d[\d/\-_.a-zA-Zа-яА-ЯёЁ() ]{0,30}?)[ ]+([\d,.]+)[ ]+([\d,.]+)(?:[ ]+([\d,.]+))?(?:[ ]+([\d,.]+))?"


def q_values(pages: DataFrame, text: str = "text", least: int = 2, most: float = 500.0, skip: tuple[str, ...] = Q_SKIP) -> DataFrame:
    """The page's columns, line_no and q: the first line without a header word that has so many numbers from 0 to most."""
    keys = [x for x in pages.columns if x != text]
    own = lines(pages, text)
    for word in skip:
        own = own.where(~F.contains("line", F.lit(word)))
    numbers = F.filter(F.transform(F.split(F.trim("line"), r"\s+"), lambda w: F.when(w.rlike(r"^\d+([.,]\d+)?$"), F.translate(w, ",", ".").try_cast("double"))), lambda x: x.isNotNull() & (x <= most))
    found = own.withColumn("q", numbers).where(F.size("q") >= least)
    return found.groupBy(*keys).agg(F.min(F.struct("line_no", "q")).alias("b")).select(*keys, "b.line_no", "b.q")


def line_points(rows: DataFrame, line: str, q: str, most_kw: float = 500.0, most_head: float = 600.0) -> DataFrame:
    """'id kW h1 h2 ..' lines with their flows (array) to a row for each point: id, kw, q, h. Heads outside 0 to most_head
    are passed over before they meet the flows; lines of another shape or power give none."""
    part = lambda i: F.regexp_extract(F.trim(line), POINT_LINE, i)
    keys = [x for x in rows.columns if x not in (line, q)]
    heads = F.filter(F.transform(F.split(part(3), r"\s+"), parse_number), lambda h: (h > 0) & (h < most_head))
    own = rows.select(*keys, F.translate(part(1), "−З", "-3").alias("id"), parse_number(part(2)).alias("kw"), heads.alias("_h"), F.col(q).alias("_q")).where((F.col("id") != "") & (F.col("kw") > 0) & (F.col("kw") <= most_kw))
    n = F.least(F.size("_h"), F.size("_q"))
    points = own.select(*keys, "id", "kw", F.inline(F.arrays_zip(F.slice("_q", 1, n).alias("q"), F.slice("_h", 1, n).alias("h"))))
    return points.withColumn("h", F.floor(F.col("h") * 10 + 0.5) / 10)


def list_records(pages: DataFrame, text: str = "text", most_q: float = 10000.0, most_h: float = 1000.0) -> DataFrame:
    """'Model Q H [speed] [power]' lines: model, q, h, rpm (0 without) and p (0 without). A third number from 800 to 3600 is
    the speed, any other the power."""
    found = records(pages, LIST_LINE, ["model", "a", "b", "c", "d"], text)
    third, fourth = parse_number(F.col("c")), parse_number(F.col("d"))
    speed = third.between(800, 3600)
    out = found.withColumns({
        "model": F.trim(F.regexp_replace("model", r"\s+", " ")), "q": parse_number(F.col("a")), "h": parse_number(F.col("b")),
        "rpm": F.when(speed, third.cast("int")).otherwise(0), "p": F.coalesce(F.when(speed, fourth).otherwise(third), F.lit(0.0)),
    })
    return out.where((F.length("model") >= 3) & (F.col("q") > 0) & (F.col("h") > 0) & (F.col("q") <= most_q) & (F.col("h") <= most_h)).drop("a", "b", "c", "d")
