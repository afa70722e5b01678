"""Curve tables: one row of flows that the model rows below it share, in raw tables and in page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import word_series_of
from ..functions.binding import bound, once
from ..functions.numbers import NUMBER, half_up
from ..sources.staging import staged

# Marks of a row of flows, of a row of heads and of a speed; the first Q may stand anywhere in its row.
Q_ROW = r"(?iu)Q\s*[(\[]?\s*(?:м[³3]\s*/?\s*ч|m[³3]\s*/?\s*h|л/мин|l/min)"
H_MARK = r"(?iu)^H\s*[(\[]?\s*(?:м|m)\s*[)\]]?"
SPEED = r"(?iu)(\d{4})\s*(?:об/мин|rpm)"
#: Power of a model row, kW; the share of the greatest flow at which a model's nominal point lies.
POWERS, SHARE = (0.03, 500.0), 0.65
FOUND = ["model", "series", "q_nom", "h_nom", "power_kw", "rpm", "q_points", "h_points", "data_source", "confidence"]


def _number(text: Column) -> Column:
    """A whole cell as a number: decimal comma or dot, no blanks inside."""
    s = F.translate(F.trim(text), ", ", ".")
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))


def _numbers(text: Column) -> Column:
    """All numbers of a text in their order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.translate(x, ",", ".").cast("double"))


def _power(x: Column) -> Column:
    return x.between(*POWERS)


def _found(rows: DataFrame, keys: list[str], q: str, h: str, source: str, confidence: Column) -> DataFrame:
    """A record with its curve, the nominal point at SHARE of the greatest flow (the first of equals), and rounded values."""
    points = F.arrays_zip(F.col(q).alias("q"), F.col(h).alias("h"))
    near = lambda aim: F.array_min(F.transform(points, lambda p, i: F.struct(F.abs(p["q"] - aim).alias("apart"), i.alias("i"), p["q"].alias("q"), p["h"].alias("h"))))
    rows, at = rows.withColumn("_at", bound(F.array_max(q) * SHARE, near)), F.col("_at")
    rounded = lambda x: F.transform(x, lambda v: half_up(v, 2))
    model = F.trim(F.regexp_replace("model", r"\n", " "))
    return rows.select(
        *keys, model.alias("model"), word_series_of(F.col("model")).alias("series"), half_up(at["q"], 2).alias("q_nom"), half_up(at["h"], 2).alias("h_nom"), F.col("power_kw"), F.coalesce("rpm", F.lit(0)).alias("rpm"),
        rounded(q).alias("q_points"), rounded(h).alias("h_points"), F.lit(source).alias("data_source"), confidence.alias("confidence"),
    )


def speed_of(text: Column) -> Column:
    """The first speed of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(text, SPEED, 1).try_cast("int"), F.lit(0))


def curves_in_tables(cells: DataFrame, headers: DataFrame, speeds: DataFrame | None = None, least_rows: int = 3, look: int = 5) -> DataFrame:
    """table_id, row_id and FOUND for each model row of a raw table with a row of flows.

    cells (table_id, row_id from 0, col_id from 0, text), headers (table_id, col_id, text), speeds (table_id, rpm). The row of
    flows is the first of the first look rows that names Q with a flow unit and holds three numbers of 0 or more, else the
    headers if they do. Its numbers, from the column of the first one on, are the flows of the columns side by side. A model row
    below it has a name left of them (the last text of three or more characters there; not a mark of heads) and at least two
    heads over 0; its power is the last number after the name, else the first one left of the flows. Tables of fewer than
    least_rows rows, or without a row of flows, give nothing; blank, null, 'none', 'nan' and '-' cells are empty.

    Rows are gathered cell by cell (a table's width), tables are not: each row meets its table's flows in a join. Joins are by
    sorted shuffles: what they meet grows with the tables, though Spark takes it for as small as the file that it is derived from.
    """
    packed = F.array_sort(F.collect_list(F.struct("col_id", F.coalesce("text", F.lit("")).alias("text"))))
    rows = cells.groupBy("table_id", "row_id").agg(packed.alias("c"))
    sizes = rows.groupBy("table_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows).select("table_id")
    heads = headers.groupBy("table_id").agg(packed.alias("c")).withColumn("row_id", F.lit(-1))
    numbers = F.filter(F.transform("c", lambda x: F.struct(x["col_id"].alias("col_id"), _number(x["text"]).alias("q"))), lambda x: x["q"] >= 0)
    named = F.array_join(F.transform("c", lambda x: x["text"]), " ").rlike(Q_ROW)
    flows = rows.where(F.col("row_id") < look).unionByName(heads.select("table_id", F.col("row_id").cast(rows.schema["row_id"].dataType), "c"))
    flows = flows.where(named).select("table_id", "row_id", numbers.alias("q")).where(F.size("q") >= 3)
    # the headers come last
    place = F.when(F.col("row_id") < 0, look).otherwise(F.col("row_id"))
    first = flows.groupBy("table_id").agg(F.min_by(F.struct("row_id", "q"), place).alias("f"))
    first = first.select("table_id", F.col("f.row_id").alias("q_row"), F.get("f.q", F.lit(0))["col_id"].alias("start"), F.transform("f.q", lambda x: x["q"]).alias("q"))

    met = rows.join(first.join(sizes.hint("merge"), "table_id").hint("merge"), "table_id").where(F.col("row_id") > F.col("q_row"))
    met = met.where(F.try_element_at("c", F.lit(-1))["col_id"] + 1 >= F.col("start") + 2)

    def record(left: Column) -> Column:
        """What a row tells by the cells left of the flows: a record, null if they are a mark of heads or hold no name."""
        filled = F.filter(left, lambda x: ~F.lower(F.trim(x["text"])).isin("", "none", "nan", "-"))
        told = F.transform(filled, lambda x: F.struct(x["col_id"].alias("col_id"), F.trim(x["text"]).alias("text"), _number(x["text"]).alias("x")))
        mark = F.trim(F.array_join(F.transform(left, lambda x: x["text"]), " "))
        return F.when(~mark.rlike(H_MARK), bound(told, lambda t: bound(F.filter(t, lambda x: x["x"].isNull() & (F.length(x["text"]) >= 3)), lambda words: named_row(t, words))))

    def named_row(told: Column, words: Column) -> Column:
        powers = F.filter(told, lambda x: _power(x["x"]))
        after = F.filter(powers, lambda x: x["col_id"] > F.get(words, F.lit(0))["col_id"])
        power = F.coalesce(F.try_element_at(after, F.lit(-1))["x"], F.try_element_at(powers, F.lit(1))["x"], F.lit(0.0))
        within = F.filter("c", lambda x: x["col_id"] >= F.col("start"))
        points = F.filter(F.transform(within, lambda x: F.struct(F.try_element_at("q", (x["col_id"] - F.col("start") + 1).cast("int")).alias("q"), _number(x["text"]).alias("h"))), lambda x: x["q"].isNotNull() & (x["h"] > 0))
        return F.when(F.size(words) > 0, F.struct(F.try_element_at(words, F.lit(-1))["text"].alias("model"), power.alias("power_kw"), points.alias("p")))

    met = once(met, bound(F.filter("c", lambda x: x["col_id"] < F.col("start")), record), ["table_id", "row_id"]).where(F.size("p") >= 2)
    met = met.select("*", F.transform("p", lambda x: x["q"]).alias("qs"), F.transform("p", lambda x: x["h"]).alias("hs"))
    met = met.join(speeds.hint("merge"), "table_id", "left") if speeds is not None else met.withColumn("rpm", F.lit(0))
    return _found(met, ["table_id", "row_id"], "qs", "hs", "curve_table", F.when(F.size("hs") >= 3, 0.85).otherwise(0.65))


def curves_in_text(pages: DataFrame, text: str = "text") -> DataFrame:
    """The page's columns, line_no and FOUND for each model line below a line of flows.

    A line of flows names Q with a flow unit and holds three numbers, or the next line does. A model line has, between runs of
    two blanks, a name (the last part of three characters that is neither a number nor a mark of heads), then a power, then at
    least three heads under the flows of the last line of flows above it; without a fitting first number there is no power.
    Lines before any line of flows, and pages without one, give nothing; null texts too.

    Lines of flows are carried down by a window over the lines of one page that are flows or can be models; a page's lines come
    from one text, so no window is longer than a text.
    """
    keys = [x for x in pages.columns if x != text]
    read = lambda x: bound(F.trim(x), lambda t: F.struct(t.alias("line"), F.coalesce(t.rlike(Q_ROW), F.lit(False)).alias("named"), _numbers(t).alias("numbers")))
    many = lambda x: F.coalesce(F.size(x["numbers"]) >= 3, F.lit(False))
    word = lambda x: x["x"].isNull() & ~x["text"].rlike(H_MARK) & (F.length(x["text"]) >= 3)

    def told(line: Column, i: Column, q: Column, taken: Column) -> Column:
        parts = F.filter(F.transform(F.split(line["line"], r"\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")
        parts = F.transform(parts, lambda x, k: F.struct(k.alias("i"), x.alias("text"), _number(x).alias("x")))
        values = lambda p, words: F.transform(F.filter(p, lambda x: x["x"].isNotNull() & (x["i"] > F.get(words, F.lit(0))["i"])), lambda x: x["x"])
        model = bound(parts, lambda p: bound(F.filter(p, word), lambda w: F.struct(F.try_element_at(w, F.lit(-1))["text"].alias("model"), F.when(F.size(w) > 0, values(p, w)).alias("values"))))
        model = F.when(~taken & (line["line"] != "") & ~(line["line"].rlike(H_MARK) & ~many(line)), model)
        return bound(model, lambda m: F.struct(i.alias("line_no"), q.alias("q"), m["model"].alias("model"), m["values"].alias("values")))

    def row(own: Column, line: Column, i: Column) -> Column:
        before, after = F.get(own, i - 1), F.get(own, i + 1)
        given = F.coalesce(before["named"] & ~many(before), F.lit(False))
        flows = many(line) & (line["named"] | given)
        # a line of flows, and one that the line before it takes for its flows, is no model line
        return told(line, i, F.when(flows, line["numbers"]), flows | (line["named"] & ~many(line) & many(after)))

    lines = bound(F.transform(F.split(F.col(text), "\n"), read), lambda own: F.transform(own, lambda x, i: row(own, x, i)))
    kept = F.filter(lines, lambda x: x["q"].isNotNull() | (F.size(x["values"]) >= 3))
    # dealt out before the work on texts and not after it: the window needs a page in one task
    cut = pages.repartition(*keys).select(*keys, speed_of(F.col(text)).alias("rpm"), F.inline(kept))
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = cut.withColumn("flows", F.last("q", ignorenulls=True).over(order)).where("q IS NULL AND flows IS NOT NULL")
    first = _power(F.get("values", F.lit(0)))
    met = met.withColumns({"power_kw": F.when(first, F.get("values", F.lit(0))).otherwise(0.0), "heads": F.when(first, F.slice("values", 2, F.size("values"))).otherwise(F.col("values"))})
    n = F.least(F.size("heads"), F.size("flows"))
    met = met.where(F.size("heads") >= 3).withColumns({"qs": F.slice("flows", 1, n), "hs": F.slice("heads", 1, n)}).where(F.size("hs") >= 3)
    return _found(met, [*keys, "line_no"], "qs", "hs", "curve_table_text", F.lit(0.80))


def first_of_model(found: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """The first record of each model of a page, capitals or not: the page, place columns and FOUND."""
    place = F.rank().over(Window.partitionBy(*page, F.upper("model")).orderBy(*order))
    return found.withColumn("_place", place).where("_place = 1").drop("_place")


def curve_records(pages: DataFrame, cells: DataFrame, headers: DataFrame, tables: DataFrame, text: str = "text") -> DataFrame:
    """Records of pages by their tables, and by their texts where no table gave any; the first of each model. tables tells the
    page of each table (table_id and the page's columns). place is the table or -1, line_no its row or the line."""
    keys = [x for x in pages.columns if x != text]
    speeds = tables.join(pages.select(*keys, speed_of(F.col(text)).alias("rpm")).hint("merge"), keys).select("table_id", "rpm")
    by_table = curves_in_tables(cells, headers, speeds).join(tables.hint("merge"), "table_id").select(*keys, F.col("table_id").cast("long").alias("place"), F.col("row_id").cast("long").alias("line_no"), *FOUND)
    by_table = staged(by_table, "curve-records")
    bare = pages.join(by_table.select(*keys).distinct().hint("merge"), keys, "left_anti")
    by_text = curves_in_text(bare.select(*keys, text), text).select(*keys, F.lit(-1).cast("long").alias("place"), F.col("line_no").cast("long").alias("line_no"), *FOUND)
    return first_of_model(by_table.unionByName(by_text), keys, ["place", "line_no"])
