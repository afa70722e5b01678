"""Extraction by dispatch: templates from a table, and extractors by the type of a page, under one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import series_of
from ..functions.numbers import parse_number
from . import pages as P
from .curve_tables import curves_in_text

#: What every extractor gives for a page, beside the page's own columns.
RECORD = {"place": "bigint", "model": "string", "series": "string", "article": "string", "q_nom": "double", "h_nom": "double", "power_kw": "double", "rpm": "int", "confidence": "double"}
#: Columns of a template: pages of its type, its own name, a Java pattern, and the fields of the pattern's groups in turn.
TEMPLATE = "type string, template string, pattern string, fields array<string>"
NUMBERS = ("q_nom", "h_nom", "power_kw", "rpm", "confidence")


def template_records(pages: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """The page's columns, template, place (of the match among those of its template) and fields (map<string,string>, empty
    groups left out) for each match of a template in a page of its type.

    pages have a column type; templates are rows of TEMPLATE, so that a new template needs no code. Pages without a template
    of their type, with a null type or text, give nothing; so does a template with a null pattern. Fields over the number of
    the pattern's groups aren't allowed. Pages meet templates in an equi join on the type.
    """
    keys = [x for x in pages.columns if x != text]
    met = pages.where(F.col(text).isNotNull()).join(templates.where("pattern IS NOT NULL"), "type")
    groups = F.transform("fields", lambda _, i: F.regexp_extract_all(F.col(text), F.col("pattern"), i + 1))
    rows = F.when(F.size(F.get(groups, F.lit(0))) > 0, F.transform(F.sequence(F.lit(0), F.size(F.get(groups, F.lit(0))) - 1), lambda k: F.transform("_groups", lambda g: F.get(g, k))))
    met = met.withColumn("_groups", groups).withColumn("_rows", rows)
    found = met.select(*keys, "template", "fields", F.posexplode("_rows").alias("place", "_values"))
    pairs = F.filter(F.arrays_zip(F.col("fields").alias("f"), F.col("_values").alias("v")), lambda x: x["v"] != "")
    return found.select(*keys, "template", F.col("place").cast("bigint").alias("place"), F.map_from_entries(pairs).alias("fields"))


def typed(found: DataFrame, keys: list[str], values: dict[str, object]) -> DataFrame:
    """RECORD from columns; what is left out of values is null."""
    return found.select(*keys, *(F.coalesce(values[x], F.lit(None)).cast(t).alias(x) if x in values else F.lit(None).cast(t).alias(x) for x, t in RECORD.items()))


def by_templates(templates: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """An extractor from a template table: the fields that have names of RECORD."""

    def extract(pages: DataFrame) -> DataFrame:
        keys = [x for x in pages.columns if x != "text"]
        found = template_records(pages, templates)
        value = {x: F.try_element_at("fields", F.lit(x)) for x in RECORD if x != "place"}
        value |= {x: parse_number(value[x]) for x in NUMBERS} | {"model": F.trim(F.regexp_replace(value["model"], r"\s+", " ")), "place": F.col("place")}
        value["series"] = F.coalesce(value["series"], series_of(value["model"]))
        return typed(found, keys, value).where("model IS NOT NULL")

    return extract


def by_lists(pages: DataFrame) -> DataFrame:
    """'Model Q H [speed] [power]' lines; a page's own speed is the default."""
    keys = [x for x in pages.columns if x != "text"]
    own = pages.withColumn("_speed", P.detect_rpm(F.col("text")))
    found = P.list_records(own)
    rpm = F.when(F.col("rpm") > 0, F.col("rpm")).otherwise(F.col("_speed"))
    return typed(found, keys, {"place": F.col("place"), "model": F.col("model"), "series": series_of(F.col("model")), "q_nom": F.col("q"), "h_nom": F.col("h"), "power_kw": F.col("p"), "rpm": rpm, "confidence": F.lit(0.75)})


def by_articles(pages: DataFrame) -> DataFrame:
    """'Model Article Q H P' lines."""
    keys = [x for x in pages.columns if x != "text"]
    found = P.records(pages, P.NOMINAL, ["model", "article", "q", "h", "p"])
    model = F.trim(F.regexp_replace("model", r"\s+", " "))
    return typed(found, keys, {"place": F.col("place"), "model": model, "series": series_of(model), "article": F.col("article"), "q_nom": parse_number(F.col("q")), "h_nom": parse_number(F.col("h")), "power_kw": parse_number(F.col("p")), "confidence": F.lit(0.9)}).where("q_nom IS NOT NULL AND h_nom IS NOT NULL")


def by_curves(pages: DataFrame) -> DataFrame:
    """Lines of models below a line of flows."""
    keys = [x for x in pages.columns if x != "text"]
    found = curves_in_text(pages)
    return typed(found, keys, {x: F.col(x) for x in RECORD if x in found.columns} | {"place": F.col("line_no")})


class Extractors:
    """Extractors by the type of page that they read. One takes pages with a column text and gives their other columns and
    RECORD; run() sees to that."""

    def __init__(self, own: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.own = dict({"list_parser": by_lists, "flat_table": by_articles, "curve_table": by_curves} if own is None else own)

    def register(self, kind: str, extract: Callable[[DataFrame], DataFrame]) -> None:
        if kind in self.own:
            raise ValueError(f"{kind} has an extractor already")
        self.own[kind] = extract

    def run(self, pages: DataFrame, kind: str = "type") -> DataFrame:
        """The page's columns, extractor and RECORD: each extractor reads the pages of its type alone. Pages of other types give
        nothing. Raises ValueError if an extractor's columns aren't those of RECORD."""
        keys = [x for x in pages.columns if x != "text"]
        want = {**{x: t for x, t in pages.dtypes if x != "text"}, **RECORD}
        out = None
        for name, extract in self.own.items():
            found = extract(pages.where(F.col(kind) == name))
            if dict(found.dtypes) != want:
                raise ValueError(f"{name} gives {found.dtypes}, not {list(want.items())}")
            found = found.select(*keys, F.lit(name).alias("extractor"), *RECORD)
            out = found if out is None else out.unionByName(found)
        if out is None:
            raise ValueError("no extractors")
        return out

    def discover(self, pages: DataFrame) -> DataFrame:
        """run() of all extractors over all pages, whatever their type: candidates for pages of unknown type."""
        kinds = F.explode(F.array(*map(F.lit, self.own)))
        return self.run(pages.withColumn("_kind", kinds), "_kind").drop("_kind")
