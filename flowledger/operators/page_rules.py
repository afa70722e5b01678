"""Rules on whole pages: which to read and how, what they are signed with, and models held against them in page joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, parse_number
from .match import ocr_verified, text_confidence

# Words and shapes that tell a page with a table.
TABLE_WORDS = ["таблица", "table", "характеристик", "specifications", "технические данные", "technical data"]
PUMP_WORDS = ["cdm", "cdmf", "cmh", "насос", "pump"]
PUMP_IDS = [r"\d{2,3}[-−]\d+[*]?", r"CDM\s*\d{2,3}[-−]\d+", r"\d{2,3}[-−]\d+[-−][АВ]", r"\d{2,3}[-−]\d+[-−]\d+[АВ]", r"CDMF\d+\+CMH\d+-\d+"]
PARAMETERS = r"(?iu)Q\s*\(м[3³]/ч\)|H\s*\(м\)|кВт|kW|Мощность|Power"
COMBINED = r"CDMF\d+\+CMH\d+-\d+"
# What a page with data says, and the shape of a model's name in it.
DATA_WORDS = r"(?iu)Артикул|кВт|м3/ч|Мощность|power|kW|flow|head|Qном|Нном"
MODEL_NAME = r"[A-ZА-Я]{2,5}\s*\d+[-]\d+"
# Header patterns that sign a catalogue, in their order.
SIGNATURES = [r"(?iu)Q\s*(?:ном|nom)?\s*\[[^\]]+\]", r"(?iu)H\s*(?:ном|nom)?\s*\[[^\]]+\]", r"(?iu)P\s*2?\s*\[(?:кВт|kW)\]", r"(?iu)(?:Модель|Model|Насос)\s*[|\s]", r"(?iu)(?:Артикул|Article)\s*[|\s]"]
# Catalogue types by a part of the file name; the first part that a name holds counts.
CATALOG_TYPES = [
    ("CDM_CDMF_241125", "CDM"), ("Katalog-CMI", "CMI"), ("Katalog-CV", "CV"), ("Katalog-NBS", "NBS"), ("Katalog-TG", "TG"), ("TD_LLT", "LLT"), ("cdlf_modeli_120", "CDLF_LARGE"), ("cdlf", "CDLF"), ("cdmf_modeli_32", "CDMF_LARGE"),
    ("cdmf", "CDMF_FANCY"), ("Каталог INL", "INL"), ("Каталог PV", "PV"), ("fancy_fst", "FST"), ("s1f9dba", "CHLF"), ("3012kuvf", "BM"), ("erxdpzux", "KMG"), ("rkohe9dt", "VO"),
]
# Ranges in which a number of a page can be a flow, a head or a power.
REASONABLE = {"q": (0.1, 1000.0), "h": (0.5, 500.0), "kw": (0.1, 500.0)}
UNVERIFIED = "gemini_unverified"


def quick_check(text: Column, look: int = 1500, least: int = 50) -> Column:
    """struct(found, kind): whether the first look characters of a text show a table of pumps, and of which kind ('CDMF+CMH',
    'CDM' or null). Texts under least characters, and null ones, show none."""
    s = F.substring(text, 1, look)
    low = F.lower(s)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    pump, ids, told = any_of(PUMP_WORDS), s.rlike("|".join(PUMP_IDS)), s.rlike(PARAMETERS)
    many = F.size(F.regexp_extract_all(s, F.lit(r"(\d+[.,]?\d*)"), F.lit(1))) > 10
    found = F.coalesce((F.length(text) >= least) & ((any_of(TABLE_WORDS) & pump) | (ids & told) | (many & pump & told)), F.lit(False))
    kind = F.when(s.rlike(COMBINED), "CDMF+CMH").when(s.rlike(r"CDM/CDMF\d+|CDM\s*\d+") | ids, "CDM")
    return F.struct(found.alias("found"), F.when(found, kind).alias("kind"))


def pages_to_read(pages: DataFrame, tables: DataFrame, by: str = "source_file", page: str = "page_num", text: str = "text") -> DataFrame:
    """by, page of the pages of each catalogue worth reading: those of tables (by, page) where the catalogue has any there, else
    those with words of data and five decimal numbers, or with a model's name and ten."""
    known = tables.select(by, page).distinct()
    decimals = F.size(F.regexp_extract_all(F.col(text), F.lit(r"(\d+[.,]\d+)"), F.lit(1)))
    good = (F.col(text).rlike(DATA_WORDS) & (decimals >= 5)) | (F.col(text).rlike(MODEL_NAME) & (decimals >= 10))
    rest = pages.join(known.select(by).distinct(), by, "left_anti").where(good).select(by, page)
    return known.unionByName(rest.distinct())


def signatures(text: Column, patterns: list[str] = SIGNATURES) -> Column:
    """array<string>: the first match of each pattern, in their order; empty without any, null for a null text."""
    found = F.array(*(F.trim(F.regexp_extract(text, p, 0)) for p in patterns))
    return F.when(text.isNotNull(), F.filter(found, lambda x: x != ""))


def catalog_type(name: Column, types: list[tuple[str, str]] = CATALOG_TYPES) -> Column:
    """The type of the first part that a file name holds, else 'UNKNOWN'."""
    return F.coalesce(*(F.when(F.contains(name, F.lit(part)), kind) for part, kind in types), F.lit("UNKNOWN"))


def brand_for_series(rows: DataFrame, brands: DataFrame, series: str = "series") -> DataFrame:
    """rows with brand: that of the series (brands: series, brand, one row for each), capitals or not, else 'Unknown'."""
    own = brands.select(F.upper(F.trim("series")).alias("_series"), "brand")
    return rows.join(own, F.upper(F.trim(series)) == F.col("_series"), "left").drop("_series").withColumn("brand", F.coalesce("brand", F.lit("Unknown")))


def page_worklist(models: DataFrame, tables: DataFrame, pages: DataFrame, by: str = "source_file", page: str = "page_num", first: int = 10) -> DataFrame:
    """by, page, task: what is left to do on the pages of each catalogue. models: by, page, complete (boolean); tables and pages:
    by, page.

    A page with models of which some are incomplete: 'validate'; a page with tables and no models: 'extract'. A catalogue without
    any model has all its pages with tables to extract, and without tables its first pages.
    """
    own = models.groupBy(by, page).agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("whole"))
    both = own.join(tables.select(by, page).distinct().withColumn("_t", F.lit(True)), [by, page], "full")
    task = F.when(F.col("whole").isNull(), "extract").when(~F.col("whole"), "validate")
    known = both.select(by, page, task.alias("task")).where("task IS NOT NULL")
    bare = pages.select(by, page).distinct().join(both.select(by).distinct(), by, "left_anti")
    order = F.row_number().over(Window.partitionBy(by).orderBy(page))
    return known.unionByName(bare.withColumn("_k", order).where(F.col("_k") <= first).select(by, page, F.lit("extract").alias("task")))


def verify_models(models: DataFrame, texts: DataFrame, by: tuple[str, ...] = ("source_file", "page_num"), sure: float = 0.8) -> DataFrame:
    """models (by, model, q, h, kw, confidence_ and source_ of each) held against the recognised texts (by, text) of their pages.

    Only models with a value over 0 whose confidence is under sure are held against their page, and only pages of such models are
    read. Where the page has the model's name (blanks and dashes don't count), each of its values is as ocr_verified() says, by
    the numbers that are REASONABLE for it. Other models, and those whose page has no text, stay as they are.
    """
    doubt = F.lit(False)
    for x in REASONABLE:
        doubt = doubt | F.coalesce((F.col(x) > 0) & (F.col(f"confidence_{x}") < sure), F.lit(False))
    own = models.withColumn("_doubt", doubt)
    asked = own.where("_doubt").select(*by).distinct()
    read = texts.join(asked, list(by), "left_semi").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("_text"))
    met = own.where("_doubt").join(read, list(by), "left")
    for x, (low, high) in REASONABLE.items():
        met = met.withColumn("_r", ocr_verified(F.col("_text"), F.col("model"), F.col(x), F.col(f"confidence_{x}"), low, high))
        told = F.col("_text").isNotNull() & (F.col("_r.source") != "unchanged")
        met = met.withColumns({x: F.when(told, F.col("_r.value")).otherwise(F.col(x)), f"source_{x}": F.when(told & (F.col("_r.source") == "ocr"), "ocr").otherwise(F.col(f"source_{x}")), f"confidence_{x}": F.when(told, F.col("_r.confidence")).otherwise(F.col(f"confidence_{x}"))})
    return own.where("NOT _doubt").select(*models.columns).unionByName(met.select(*models.columns))


def confirm_models(models: DataFrame, texts: DataFrame, by: tuple[str, ...] = ("source_file", "page_num")) -> DataFrame:
    """models (by, model, q_nom, h_nom, power_kw, confidence, data_source) with the confidence that their page's text gives them, as
    text_confidence() says; at .35 the data_source is UNVERIFIED. Models of one character or none are dropped; a page without a
    text confirms nothing."""
    met = models.where(F.length("model") >= 2).join(texts.select(*by, F.col("text").alias("_text")), list(by), "left")
    conf = text_confidence(F.coalesce("_text", F.lit("")), F.col("model"), [F.col(x) for x in ("q_nom", "h_nom", "power_kw")])
    met = met.withColumn("confidence", conf)
    return met.withColumn("data_source", F.when(F.col("confidence") == 0.35, UNVERIFIED).otherwise(F.col("data_source"))).select(*models.columns)


COMBINED_LINE = r"^(CDMF\d+-\d+\+CMH\d+-\d+)\s+([\d.,]+\+[\d.,]+)\s+(.+)$"


def combined_points(rows: DataFrame, line: str, q: str, most_kw: float = 500.0, most_head: float = 600.0) -> DataFrame:
    """'CDMF1-2+CMH1-2 0.37+0.55 h1 h2 ..' lines with their flows (array) to a row for each point: id, kw (both powers together), q,
    h. Torn words and numbers are joined first; heads outside 0 to most_head are passed over before they meet the flows; lines
    of another shape or power give none."""
    s = F.regexp_replace(F.trim(line), r"CM\s+H", "CMH")
    s = F.regexp_replace(F.regexp_replace(s, r"(\d)\s+\.(\d)", "$1.$2"), r"\.\s+(\d)", ".$1")
    part = lambda i: F.regexp_extract(s, COMBINED_LINE, i)
    keys = [x for x in rows.columns if x not in (line, q)]
    powers = F.transform(F.split(part(2), r"\+"), lambda x: F.coalesce(parse_number(x), F.lit(0.0)))
    heads = F.filter(F.transform(F.split(F.regexp_replace(part(3), r"(\d)\s+(\d)(?=\s|$)", "$1$2"), r"\s+"), parse_number), lambda h: (h > 0) & (h < most_head))
    own = rows.select(*keys, part(1).alias("id"), F.aggregate(powers, F.lit(0.0), lambda a, x: a + x).alias("kw"), heads.alias("_h"), F.col(q).alias("_q")).where((F.col("id") != "") & (F.col("kw") > 0) & (F.col("kw") <= most_kw))
    n = F.least(F.size("_h"), F.size("_q"))
    points = own.select(*keys, "id", half_up(F.col("kw"), 2).alias("kw"), F.inline(F.arrays_zip(F.slice("_q", 1, n).alias("q"), F.slice("_h", 1, n).alias("h"))))
    return points.withColumn("h", half_up(F.col("h"), 1))
