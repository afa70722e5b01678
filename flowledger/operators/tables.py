"""Raw tables: headers to fields, shapes, wide and long forms. Cells are rows (table_id, row_id, col_id, text) and headers
rows (table_id, col_id, text), so that a table of any size is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound, once
from ..functions.numbers import half_up, parse_number
from ..functions.units import convert
from ..sources.staging import staged

# Header words of each field in six languages, in the order in which equal scores are settled.
HEADER_WORDS = {
    "model": [
        "модель", "тип", "насос", "наименование", "обозначение", "марка", "model", "type", "pump", "designation", "name", "item", "modell", "typ", "pumpe", "bezeichnung", "baureihe",
        "modello", "tipo", "pompa", "denominazione", "modèle", "pompe", "désignation", "modelo", "bomba", "denominación",
    ],
    "q_nom": [
        "подача", "расход", "производительность", "объёмная подача", "flow", "capacity", "delivery", "discharge", "flow rate", "förderstrom", "fördermenge", "volumenstrom", "durchfluss",
        "portata", "portata nominale", "débit", "débit nominal", "caudal", "caudal nominal",
    ],
    "h_nom": [
        "напор", "высота подачи", "давление нагнетания", "head", "total head", "delivery head", "discharge head", "förderhöhe", "druckhöhe", "gesamtförderhöhe",
        "prevalenza", "altezza manometrica", "hauteur", "hauteur manométrique", "altura", "altura manométrica",
    ],
    "power_kw": [
        "мощность", "мощн", "потребляемая мощность", "power", "motor power", "rated power", "shaft power", "input power", "leistung", "motorleistung", "nennleistung", "wellenleistung",
        "potenza", "potenza motore", "potenza nominale", "puissance", "puissance moteur", "potencia", "potencia motor",
    ],
    "rpm": ["обороты", "частота вращения", "скорость", "speed", "rpm", "rotational speed", "rev/min", "drehzahl", "nenndrehzahl", "velocità", "giri/min", "vitesse", "tours/min", "velocidad"],
    "article": ["артикул", "код", "каталожный номер", "номер заказа", "article", "code", "part number", "order number", "catalog number", "item no", "artikelnummer", "bestellnummer", "katalognummer", "codice", "articolo", "numero d'ordine"],
    "dn": ["dn", "ду", "патрубок", "присоединение", "фланец", "flange", "connection", "port size", "inlet", "outlet", "suction", "discharge", "anschluss", "nennweite", "saugstutzen", "druckstutzen"],
    "weight": ["масса", "вес", "weight", "mass", "net weight", "gewicht", "masse", "peso", "massa"],
    "npsh": ["npsh", "кавитационный запас", "npshr", "npsh required", "haltedruckhöhe"],
    "efficiency": ["кпд", "эффективность", "efficiency", "eta", "η", "wirkungsgrad", "rendimento"],
    "stages": ["stages", "ступени", "stufen", "stadi"],
}
SYMBOLS = {"q_nom": "Q", "h_nom": "H", "power_kw": "P"}
DIMENSIONS = ["b", "l", "d", "a", "h1", "h2", "b1", "b2", "l1", "l2", "d1", "d2", "a1", "a2"]
NEGATIVE = ["npsh", "кавитац", "габарит", "dimension", "abmessung", "installation", "установк", "монтаж", "spare", "запчаст", "accessories", "принадлежност", "zubehör"]
# Shapes of model names, and of values that are none (article, voltage, flange, classes, sizes, duty, share).
POSITIVE_SHAPES = r"[A-ZА-ЯЁ]{2,}[\s\-]?\d+|[A-Z]{1,5}\d{1,3}[\-/]\d{1,3}|[A-Z]{2,}\s+\d+[\-/]\d+[\-/]\d+"
NEGATIVE_SHAPES = r"^(\d{6,10}$|[123]~\s?\d{3}\s?V|DN\s?\d+$|IE[1-5]$|IP\s?\d{2}$|[A-F]$|\d+\s*(кг|kg|мм|mm|°C)$|(S1|S2|S3|S6)$|\d+(\.\d+)?\s*%$)"
# Speeds of motors, and the start of a model's name.
RPM_VALUES = [960, 980, 1000, 1450, 1475, 1500, 1750, 2900, 2950, 3000, 3450, 3500, 3600]
MODEL_TEXT = r"^[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё]*[\s\-_]?\d"


def clean_header(text: Column, breaks: str = " ") -> Column:
    """Small letters, single blanks, without what stands in brackets; breaks takes the place of line breaks."""
    s = F.trim(F.regexp_replace(F.trim(F.lower(F.regexp_replace(text, r"[\n\r]", breaks))), r"\s+", " "))
    return F.trim(F.regexp_replace(s, r"\s*[(\[].*?[)\]]\s*", " "))


def header_field(text: Column, words: dict[str, list[str]] = HEADER_WORDS) -> Column:
    """struct(field, score): the field with the longest word in the header, or 5 for its bare symbol; null without one. A line
    break counts as a blank, or as nothing where it tears a word."""
    row = lambda score, i, field, w: F.struct(F.lit(score).alias("score"), F.lit(-i).alias("place"), F.lit(field).alias("field"), F.lit(w).alias("word"))
    known = F.array(*(row(len(w), i, field, w) for i, (field, own) in enumerate(words.items()) for w in own))
    symbols = [(SYMBOLS[field], row(5, i, field, "")) for i, field in enumerate(words) if field in SYMBOLS]

    def best(both: Column) -> Column:
        found = F.filter(known, lambda x: F.contains(both["h"], x["word"]) | F.contains(both["joined"], x["word"]))
        if symbols:
            found = F.concat(found, F.array_compact(F.array(*(F.when(both["h"].rlike(f"(?i)^{symbol}([^a-zA-Z]|$)"), x) for symbol, x in symbols))))
        return bound(F.array_max(found), lambda x: F.when(x["score"] > 0, F.struct(x["field"].alias("field"), x["score"].alias("score"))))

    return bound(F.struct(clean_header(text).alias("h"), clean_header(text, "").alias("joined")), best)


def match_headers(headers: DataFrame, words: dict[str, list[str]] = HEADER_WORDS) -> DataFrame:
    """headers (text and others) with field and score, null without one. Each row is matched by itself, so that the few texts that
    all tables share are no hot keys; a filter on field isn't worked into the match."""
    return headers.select(*headers.columns, F.inline(F.array(F.struct(header_field(F.col("text"), words).alias("_f"))))).select(*headers.columns, "_f.field", "_f.score")


def infer_from_values(cells: DataFrame, rpm_values: list[int] = RPM_VALUES) -> DataFrame:
    """table_id, col_id, field: what a column without a telling header holds by its values: model, article or rpm."""
    text = F.trim("text")
    number = parse_number(F.col("text"))
    filled = F.count_if(text != "")
    numeric = F.count_if(number.isNotNull())
    words = filled - numeric
    positive = F.count_if(number.isNull() & text.rlike(POSITIVE_SHAPES))
    negative = F.count_if(number.isNull() & text.rlike(NEGATIVE_SHAPES))
    articles = F.count_if(text.rlike(r"^\d{5,12}$"))
    speeds = F.count_if(number.isin([float(x) for x in rpm_values]))
    field = (
        F.when((numeric / filled < 0.5) & (words >= 2) & (positive > words * 0.3) & (negative < words * 0.5), "model")
        .when((numeric / filled > 0.8) & (numeric >= 2) & (articles > F.count("*") * 0.7), "article")
        .when((numeric / filled > 0.7) & (numeric >= 2) & (speeds > numeric * 0.8), "rpm")
    )
    return cells.groupBy("table_id", "col_id").agg(F.when(filled > 0, field).alias("field"))


def resolve_columns(found: DataFrame) -> DataFrame:
    """One column for each field of a table: the highest score, then the first column. found: table_id, col_id, field, score."""
    best = found.where("field IS NOT NULL").groupBy("table_id", "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "col_id")).alias("b"))
    return best.select("table_id", "field", "b.col_id", (-F.col("b.s")).alias("score"))


def reject_dimension_tables(headers: DataFrame, least: int = 3, negative: list[str] = NEGATIVE, texts: DataFrame | None = None, look: int = 500) -> DataFrame:
    """table_id of tables that have fewer than least different headers of dimensions, and whose headers, and the first look
    characters of their page (texts: table_id, text), don't speak of dimensions, cavitation or accessories."""
    low = F.lower(F.trim("text"))
    bad = lambda t: F.exists(F.array(*map(F.lit, negative)), lambda w: F.contains(t, w))
    told = headers.groupBy("table_id").agg(F.countDistinct(F.when(low.isin(DIMENSIONS), low)).alias("d"), F.bool_or(bad(low)).alias("n")).where((F.col("d") < least) & ~F.col("n")).select("table_id")
    if texts is None:
        return told
    return told.join(texts.where(bad(F.lower(F.substring("text", 1, look)))).select("table_id"), "table_id", "left_anti")


def drop_heights(columns: DataFrame, headers: DataFrame, least: int = 2) -> DataFrame:
    """columns (table_id, col_id, field and others) without the heads that are heights: their header names millimetres, or least
    different headers of the table are dimensions. Other fields stay."""
    low = F.lower(F.trim("text"))
    sized = headers.groupBy("table_id").agg(F.countDistinct(F.when(low.isin(DIMENSIONS), low)).alias("_d")).where(F.col("_d") >= least).select("table_id")
    small = headers.where(F.lower("text").rlike("mm|мм")).select("table_id", "col_id")
    heads = columns.where("field = 'h_nom'").join(sized, "table_id", "left_anti").join(small, ["table_id", "col_id"], "left_anti")
    return columns.where("field IS NULL OR field <> 'h_nom'").unionByName(heads.select(*columns.columns))


def is_pump_table(columns: DataFrame, cells: DataFrame, numeric_share: float = 0.3) -> DataFrame:
    """table_id, pump: a model, a flow or head column, two rows, and enough numeric cells."""
    fields = columns.groupBy("table_id").agg(F.bool_or(F.col("field") == "model").alias("m"), F.bool_or(F.col("field").isin("q_nom", "h_nom")).alias("v"))
    body = cells.groupBy("table_id").agg(F.countDistinct("row_id").alias("n"), F.avg(parse_number(F.col("text")).isNotNull().cast("double")).alias("share"))
    return body.join(fields, "table_id", "left").select("table_id", F.coalesce(F.col("m") & F.col("v") & (F.col("n") >= 2) & (F.col("share") >= numeric_share), F.lit(False)).alias("pump"))


def rows_to_entries(cells: DataFrame, columns: DataFrame, fields: list[str], units: dict[str, Column] | None = None) -> DataFrame:
    """One record for each row: a column for each field, numbers for all but model and article. columns: table_id, col_id, field."""
    joined = cells.join(columns.select("table_id", "col_id", "field"), ["table_id", "col_id"])
    pivoted = joined.groupBy("table_id", "row_id").pivot("field", fields).agg(F.first("text"))
    out = {}
    for x in fields:
        if x in ("model", "article"):
            continue
        value = parse_number(F.col(x))
        kind = {"q_nom": "q", "h_nom": "h", "power_kw": "p"}.get(x)
        out[x] = convert(value, units[x], kind) if units and x in units and kind else value
    return pivoted.withColumns(out)


def transpose_spec(cells: DataFrame, labels: DataFrame, params: list[str]) -> DataFrame:
    """Parameter rows and model columns to one record for each model column; the first row of a parameter counts.
    labels: table_id, row_id, param."""
    joined = cells.join(labels, ["table_id", "row_id"])
    first = joined.groupBy("table_id", "col_id", "param").agg(F.min(F.struct("row_id", "text"))["text"].alias("text"))
    pivoted = first.groupBy("table_id", "col_id").pivot("param", params).agg(F.first("text"))
    return pivoted.withColumns({p: parse_number(F.col(p)) for p in params})


# Words of parameters in the first column, in the order in which a cell is told.
PARAMETER_WORDS = ["модель", "model", "расход", "подача", "flow", "capacity", "напор", "head", "мощность", "power", "обороты", "speed", "rpm", "тип", "type", "насос", "pump", "delivery", "prevalenza"]
PARAMETERS = {"q": ["расход", "подача", "flow", "capacity", "delivery"], "h": ["напор", "head", "prevalenza"], "p": ["мощность", "power", "potenza", "leistung"], "rpm": ["обороты", "speed", "rpm", "частота вращения"]}


def range_middle(text: Column) -> Column:
    """'8-12,5' is 10.25; a number is itself; null otherwise."""
    s = F.translate(F.trim(text), ", ", ".")
    shape = r"^([\d.]+)\s*[-–—]\s*([\d.]+)"
    low, high = (F.regexp_extract(s, shape, i).try_cast("double") for i in (1, 2))
    return F.coalesce(half_up((low + high) / 2, 2), F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), s.try_cast("double")))


def transposed_records(cells: DataFrame, headers: DataFrame, speeds: DataFrame | None = None, look: int = 15) -> DataFrame:
    """table_id, col_id, model, q, h, p (0 where nothing tells), rpm of each column of tables whose first column names parameters.

    cells: table_id, row_id from 0, col_id from 0, text; headers: table_id, col_id, text; speeds: table_id, rpm of the page. A
    table needs three rows and columns, two cells with words of parameters among the first look rows of its first column, and one
    of flow or head. Of several rows of a parameter the last counts. Ranges give their middle; a speed counts from 800 to 3600,
    else the page's (0 without). Columns whose header has under two characters, or without flow and head, give nothing.

    Joins are by sorted shuffles: what they meet grows with the tables, though Spark takes it for as small as the file that it
    is derived from and would send it through the driver.
    """
    has = lambda low, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    first = cells.where((F.col("col_id") == 0) & (F.col("row_id") < look))
    param = lambda low: F.coalesce(*(F.when(has(low, words), name) for name, words in PARAMETERS.items()))
    told = bound(F.lower(F.trim("text")), lambda low: F.struct(F.coalesce(has(low, PARAMETER_WORDS), F.lit(False)).alias("hit"), param(low).alias("param")))
    told = once(first, told, ["table_id", "row_id"])
    rows = told.groupBy("table_id").agg(F.count_if("hit").alias("hits"), *(F.max(F.when(F.col("param") == x, F.col("row_id"))).alias(f"_{x}") for x in PARAMETERS))
    sizes = cells.groupBy("table_id").agg((F.max("row_id") + 1).alias("_rows")).join(headers.groupBy("table_id").agg(F.count("*").alias("_columns")).hint("merge"), "table_id").where("_rows >= 3 AND _columns >= 3").select("table_id")
    rows = rows.where("hits >= 2 AND coalesce(_q, _h) IS NOT NULL").join(sizes.hint("merge"), "table_id")
    at = F.array_compact(F.array(*(F.when(F.col(f"_{x}").isNotNull(), F.struct(F.col(f"_{x}").alias("row_id"), F.lit(x).alias("param"))) for x in PARAMETERS)))
    wanted = rows.select("table_id", F.inline(at))
    values = cells.where("col_id > 0").join(wanted.hint("merge"), ["table_id", "row_id"]).groupBy("table_id", "col_id").agg(*(F.max(F.when(F.col("param") == x, range_middle(F.col("text")))).alias(x) for x in PARAMETERS))
    models = headers.where("col_id > 0").select("table_id", "col_id", F.trim("text").alias("model")).where(F.length("model") >= 2)
    own = models.join(values.hint("merge"), ["table_id", "col_id"])
    own = own.join(speeds.withColumnRenamed("rpm", "_page").hint("merge"), "table_id", "left") if speeds is not None else own.withColumn("_page", F.lit(0))
    value = lambda x: half_up(F.coalesce(x, F.lit(0.0)), 2).alias(x)
    rpm = F.coalesce(F.when(F.col("rpm").between(800, 3600), F.col("rpm").cast("int")), F.col("_page"), F.lit(0))
    return own.select("table_id", "col_id", "model", value("q"), value("h"), value("p"), rpm.cast("int").alias("rpm")).where("q > 0 OR h > 0")


def is_transposed(cells: DataFrame, words: list[str], first: int = 10) -> DataFrame:
    """table_id, transposed, confidence: parameter words in three of the first rows' first cells, or in two and over 30 % of all
    rows' first cells."""
    order = Window.partitionBy("table_id").orderBy("row_id")
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("text"), w))
    heads = cells.where("col_id = 0").select("table_id", "row_id", F.coalesce(hit, F.lit(False)).alias("hit"))
    counted = heads.groupBy("table_id").agg(F.count_if("hit").alias("k"), F.count("*").alias("n"))
    early = heads.withColumn("_place", F.row_number().over(order)).where((F.col("_place") <= first) & F.col("hit")).groupBy("table_id").agg(F.count("*").alias("e"))
    counted = counted.join(early, "table_id", "left").withColumn("e", F.coalesce("e", F.lit(0)))
    many, some = F.col("e") >= 3, (F.col("k") >= 2) & (F.col("k") > F.col("n") * 0.3)
    return counted.select("table_id", (many | some).alias("transposed"), F.when(many, F.least(F.lit(0.95), F.lit(0.6) + F.col("e") * 0.1)).when(some, 0.8).otherwise(0.0).alias("confidence"))


def numeric_runs(cells: DataFrame, least: int = 5) -> DataFrame:
    """The longest run of rising numbers in neighbouring columns of each row, of at least so many: table_id, row_id,
    first_col, n. The first of equal runs counts."""
    order = Window.partitionBy("table_id", "row_id").orderBy("col_id")
    number = cells.withColumn("x", parse_number(F.col("text"))).where("x IS NOT NULL")
    breaks = ~((F.col("col_id") == F.lag("col_id").over(order) + 1) & (F.col("x") > F.lag("x").over(order)))
    marked = number.withColumn("_new", F.coalesce(breaks, F.lit(True)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy("table_id", "row_id", "_run").agg(F.min("col_id").alias("first_col"), F.count("*").alias("n")).where(F.col("n") >= least)
    best = sizes.groupBy("table_id", "row_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first_col")).alias("b"))
    return best.select("table_id", "row_id", "b.first_col", (-F.col("b.m")).alias("n"))


def unpivot_matrix(cells: DataFrame, q_header: DataFrame, least: int = 2, share: float = 0.65) -> DataFrame:
    """A row's heads under the header's flows as a curve with its point nearest to a share of the greatest flow.
    q_header: table_id, col_id, q. Heads of 0 or less don't count; rows with fewer than least points are dropped."""
    points = cells.join(q_header, ["table_id", "col_id"]).withColumn("h", parse_number(F.col("text"))).where("h > 0")
    ordered = F.array_sort(F.collect_list(F.struct("q", "h")))
    curves = points.groupBy("table_id", "row_id").agg(ordered.alias("p")).where(F.size("p") >= least)
    aim = F.element_at("p", -1)["q"] * share
    best = F.array_min(F.transform("p", lambda x, i: F.struct(F.abs(x["q"] - aim).alias("apart"), i.alias("i"), x["q"].alias("q"), x["h"].alias("h"))))
    return curves.select("table_id", "row_id", F.transform("p", lambda x: x["q"]).alias("q_points"), F.transform("p", lambda x: x["h"]).alias("h_points"), best["q"].alias("q_nom"), best["h"].alias("h_nom"))


def selection_chart(cells: DataFrame, q_axis: DataFrame, h_axis: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cells that name models, with flows along columns and heads along rows: mean flow and head of each model.
    q_axis: table_id, col_id, q; h_axis: table_id, row_id, h. Cells are counted by column and model before they meet the flows, so
    that a column of many cells isn't sorted in one task. With tasks, both steps are dealt out to so many."""
    deal = lambda rows, *by: rows if tasks is None else rows.repartition(tasks, *by)
    named = cells.where("text IS NOT NULL AND trim(text) <> ''").join(h_axis, ["table_id", "row_id"]).select("table_id", "col_id", F.trim("text").alias("model"), F.col("h").cast("double").alias("h"))
    counted = deal(named, "table_id", "col_id", "model").groupBy("table_id", "col_id", "model").agg(F.sum("h").alias("h"), F.count("h").alias("n_h"), F.count("*").alias("n"))
    met = deal(counted, "table_id", "col_id").join(q_axis, ["table_id", "col_id"])
    mean = lambda total, n: F.try_divide(F.sum(total), F.sum(n))
    q = mean(F.col("n") * F.col("q").cast("double"), F.when(F.col("q").isNotNull(), F.col("n")))
    return met.groupBy("table_id", "model").agg(q.alias("q_nom"), mean("h", "n_h").alias("h_nom"), F.sum("n").alias("n"))


def table_types(features: DataFrame) -> DataFrame:
    """type and confidence of a table by its features: transposed, transposed_conf, matrix, model, q, h, power, n_cols, n_rows,
    curve_header, model_lines."""
    c = F.col
    flat = (c("n_cols") >= 3) & (c("n_rows") >= 2) & c("model") & (c("q") | c("h"))
    kind = F.when(c("transposed"), "transposed").when(c("matrix"), "qh_matrix").when(flat, "flat").when(c("curve_header") & (c("model_lines") >= 2), "curve").when((c("n_cols") <= 2) & (c("n_rows") >= 5), "list").otherwise("unknown")
    by_flat = F.when(c("power"), 0.90).when(c("q") & c("h"), 0.85).otherwise(0.70)
    conf = F.when(kind == "transposed", c("transposed_conf")).when(kind == "qh_matrix", 0.90).when(kind == "flat", by_flat).when(kind == "curve", 0.80).when(kind == "list", 0.60).otherwise(0.0)
    return features.withColumns({"table_type": kind, "type_confidence": conf})


def best_table(typed: DataFrame, page: list[str]) -> DataFrame:
    """The surest table of each page, the first among equals: table_id, table_type, type_confidence."""
    best = typed.groupBy(*page).agg(F.min(F.struct((-F.col("type_confidence")).alias("c"), "table_id", "table_type")).alias("b"))
    return best.select(*page, "b.table_id", "b.table_type", (-F.col("b.c")).alias("type_confidence"))


def forward_fill(cells: DataFrame, column: int) -> DataFrame:
    """Blank cells of a column take the text above."""
    order = Window.partitionBy("table_id", "col_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    text = F.when(F.trim("text") != "", F.col("text"))
    filled = cells.where(F.col("col_id") == column).withColumn("text", F.coalesce(F.last(text, ignorenulls=True).over(order), F.col("text")))
    return cells.where(F.col("col_id") != column).unionByName(filled)


def split_merged(cells: DataFrame) -> DataFrame:
    """Cells of several lines to one row for each: part counts the lines of a cell from 0, so that the cells of a row meet by
    (table_id, row_id, part)."""
    return cells.select("table_id", "row_id", "col_id", F.posexplode(F.split("text", "\n")).alias("part", "text")).withColumn("text", F.trim("text"))


def assignment_score(triples: DataFrame, by: list[str], q: str = "q", h: str = "h", p: str = "p") -> DataFrame:
    """How far the mean efficiency of a choice of columns is from .5 to .7; 999 for fewer than two rows."""
    from ..functions.physics import efficiency

    eta = efficiency(F.col(q), F.col(h), F.col(p))
    mean = F.avg(F.when((eta > 0) & (eta < 1.5), eta))
    off = F.when(mean < 0.5, F.lit(0.5) - mean).when(mean > 0.7, mean - 0.7).otherwise(0.0)
    return triples.groupBy(*by).agg(F.when(F.count(F.when((eta > 0) & (eta < 1.5), eta)) < 2, 999.0).otherwise(off).alias("score"))


def choose_extraction(main: DataFrame, fallback: DataFrame, by: str, bad: Column) -> DataFrame:
    """by, choice: 'fallback' where over half of the main rows are bad and the fallback has a smaller share of bad rows."""
    share = lambda df, n: df.groupBy(by).agg(F.avg(bad.cast("double")).alias(n))
    both = share(main, "m").join(share(fallback, "f"), by, "left")
    return both.select(by, F.when((F.col("m") > 0.5) & (F.col("f") < F.col("m")), "fallback").otherwise("main").alias("choice"))


def sequential_pick(results: DataFrame, by: list[str]) -> DataFrame:
    """The extractor result of each page: the best score, the first of equals; then, in order, any other with a score of 50
    or more and half again as many records as the one held. results: place, extractor, score, n. A page has a few results."""
    rows = F.array_sort(F.collect_list(F.struct("place", "extractor", "score", "n")))
    packed = results.where("n > 0").groupBy(*by).agg(rows.alias("r"))
    best = F.aggregate(F.slice("r", 2, F.size("r")), F.element_at("r", 1), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    better = lambda a, x: (x["place"] != a["place"]) & (x["score"] >= 50) & (x["n"] >= a["n"] * 1.5)
    final = F.aggregate("r", best, lambda a, x: F.when(better(a, x), x).otherwise(a))
    return packed.select(*by, final.alias("b")).select(*by, "b.extractor", "b.score", "b.n")


def span_rows(spans: DataFrame, by: list[str], tolerance: float = 3.0) -> DataFrame:
    """Spans (y, x, text) of a page to rows: by, y, x, text, row_no, col_no (by x, then text). From the topmost span on, a span joins
    the row whose first span is at most tolerance (over 0) above it, else it starts a row. Spans with a null y, or a null page,
    are left out.

    Every height points to the next one beyond its tolerance: pages are cut into strips as high as the tolerance, and within a
    strip heights and the ends of reaches from the strip before are merged in one order. The heights that start rows are those
    that the pointers reach from the topmost; each round doubles how far they reach, so a page of n rows takes log2(n) rounds.
    No page is gathered in one task: what meets is a strip, a row, or the strips of a page (a number each).
    """
    keys = [F.col(x) for x in by]
    page = Window.partitionBy(*by)
    strip = lambda y: F.floor(y / tolerance)
    known = spans.select(*by, F.col("y").cast("double").alias("y"), "x", "text").where(F.col("y").isNotNull())
    for x in by:
        known = known.where(F.col(x).isNotNull())
    heights = staged(known.select(*by, "y").distinct().withColumn("s", strip(F.col("y"))), "heights")
    # the lowest height of the strips after the next one
    strips = heights.groupBy(*by, "s").agg(F.min("y").alias("top"))
    later = strips.withColumns({"n1": F.lead("s").over(page.orderBy("s")), "t1": F.lead("top").over(page.orderBy("s")), "t2": F.lead("top", 2).over(page.orderBy("s"))})
    later = later.select(*by, "s", F.when(F.col("n1") > F.col("s") + 1, F.col("t1")).otherwise(F.col("t2")).alias("far"))
    # the first height in the next strip that is beyond the reach: heights and reaches in one order, from below
    reach = heights.select(*by, (F.col("s") + 1).alias("s"), (F.col("y") + tolerance).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("to"), F.col("y").alias("own"))
    both = reach.unionByName(heights.select(*by, "s", F.col("y").alias("at"), F.lit(1).alias("kind"), F.col("y").alias("to"), F.lit(None).cast("double").alias("own")))
    below = Window.partitionBy(*by, "s").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("to", ignorenulls=True).over(below)).where("kind = 0").select(*by, F.col("own").alias("y"), "near")
    pointers = heights.join(near, [*by, "y"]).join(later, [*by, "s"]).select(*by, "y", F.coalesce("near", "far").alias("p"))
    pointers = staged(pointers.where("p IS NOT NULL"), "pointers")
    starts = staged(heights.groupBy(*by).agg(F.min("y").alias("y")), "starts")
    while not pointers.isEmpty():
        more = starts.join(pointers, [*by, "y"]).select(*by, F.col("p").alias("y"))
        starts = staged(starts.unionByName(more).distinct(), "starts")
        beyond = pointers.select(*by, F.col("y").alias("p"), F.col("p").alias("q"))
        pointers = staged(pointers.join(beyond, [*by, "p"]).select(*by, "y", F.col("q").alias("p")), "pointers")
    rows = starts.withColumn("row_no", (F.row_number().over(page.orderBy("y")) - 1).cast("int"))
    rows = rows.select(*by, F.col("y").alias("start"), "row_no", F.explode(F.array(strip(F.col("y")), strip(F.col("y")) + 1)).alias("s"))
    own = known.withColumn("s", strip(F.col("y"))).join(rows, [*by, "s"]).where((F.col("y") >= F.col("start")) & (F.col("y") - F.col("start") <= tolerance))
    place = F.row_number().over(Window.partitionBy(*by, "row_no").orderBy("x", "text")) - 1
    return own.select(*keys, "y", "x", "text", "row_no", place.cast("int").alias("col_no"))
