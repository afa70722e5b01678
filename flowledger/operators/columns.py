"""Roles of table columns by their headers, and records read along them, with fallbacks where a cell is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound, once
from ..functions.modelcodes import clean_raw_name
from ..functions.names import plain_key
from ..functions.numbers import half_up, parse_number_rich

# Header words of each role, sizes that tables of dimensions have, and words of heads for the fallback.
MODEL_WORDS = ["модель", "model", "тип", "type", "наименование", "обозначение", "pump type", "pump model", "size"]
FLOW_WORDS = ["подача", "расход", "flow", "q,", "q ", "м³/ч", "m3/h", "производительность", "capacity", "qном", "q"]
HEAD_WORDS = ["напор", "head", "h,", "нном", "hном", "метрах", "метров"]
POWER_WORDS = ["мощность", "power", "квт", "kw", "p2", "p₂", "мощн", "р2"]
SPEED_WORDS = ["об/мин", "rpm", "частота вращения", "скорость", "n,"]
HORSE_WORDS = ["hp", "л.с.", "лс"]
PUMP_WORDS = ["модель", "model", "насос", "pump", "наименование"]
DIMENSION_WORDS = ["размеры [мм]", "dimensions [mm]", "габаритные размеры"]
DIMENSION_CODES = ["a", "a1", "a2", "b", "b1", "b2", "c", "d", "d1", "d2", "e", "f", "l", "l1", "l2", "h1", "h2", "w", "w1", "w2", "n1", "n2", "s", "kg", "mm"]
MILLIMETRES = ["(мм)", "(mm)", "[мм]", "[mm]", "мм]", "mm]"]
OTHER_HEAD_WORDS = ["head", "h=", "hauteur", "altura", "напор", "метрах", "метров", "столба"]
# The series of model names, and their shape.
MODEL_SHAPE = (
    r"(?iu)^(?:(?:CDM|CDMF|CV|CVF|CMI|NBS|TG|TL|TD|FST|FS4|FSM|FV|FVH|EVR|EVS|CDL|CDLF|INL|MBL|МВL|МBL|CHL|CHLF|BM|BMN|LVR|EST|ESST|LLT)"
    r"|(?:CEA|CA[M]?|e-SV|e-HM|e-NSC|e-GS|e-LNE|e-IXP|FH[EFS]?|FC[T]?|ESH|VM|BG|CO|SVI|DOC|DOMO|DIWA|SCUBA|\dSC)|(?:ZS|SJ)|(?:DW[F]?|CDX[M]?|MATRIX|EVMS[NKL]?|GP[E]?|CDA|BestOne)"
    r"|(?:PK[m]?|CP[m]?|HT|RX|TOP|UP|BC|\d+SR|\d+HR)|(?:CR[IENM]?|CM[E]?|SP[A]?)|(?:MHI[L]?|MVI[LSE]?|Helix|CronoLine|CronoTwin|CronoBloc)|(?:Etanorm|Movitec|Multitec|MegaCPK)"
    r"|(?:SET|NKM|NKP|KDN|KH|NOVA|FEKA|DRENAG|VEA|ALM|KLM|DKLM)|(?:[A-ZА-Я]{1,5}\d))\s*[/]?\s*\w*\s*\d+[\s\-/]*\d*"
)
HORSE_KW = 0.7457
ROLES = ["model_col", "q_col", "h_col", "kw_col", "rpm_col", "hp_col"]


def _has(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _head(low: Column) -> Column:
    """Words of heads, or 'h ' (the first) that no slash stands before: 'm/h ' is a flow."""
    at = F.instr(low, F.lit("h "))
    return _has(low, HEAD_WORDS) | ((at > 0) & ((at == 1) | (F.substring(low, at - 1, F.lit(1)) != "/")))


def is_flow_point(text: Column) -> Column:
    """Whether a header is a flow of a grid: numbers and flow units only, numbers and a word of heads, or 'q=' and more."""
    low = F.lower(F.trim(text))
    bare = F.regexp_replace(F.regexp_replace(low, "gpm|min|l|m|h", ""), r"[/\s.×,]", "")
    return (F.length(low) >= 3) & (bare.rlike(r"^\d+$") | low.rlike(r"^\d+[.\d]*\.(?:h=|head|напор)") | low.rlike(r"^q[=\s]"))


def column_roles(headers: DataFrame) -> DataFrame:
    """table_id, a column number (or null) for each of ROLES, grid (the table is a grid of flows), h_in_mm, and names: the headers
    in order as array<struct(col_id, text)>.

    headers: table_id, col_id, text. A column has one role. The model is the first column with one of its words; the flow the
    first other one with words of flows and none of heads, unless four columns or more speak of flows or are flow points; the
    head the first other one with words of heads; then power, speed and horse power alike. A column that speaks of power and of
    heads is one of power; a bare 'h' beside three columns of dimensions is none of heads. A table without words for models
    that speaks of dimensions has no roles at all. Null headers count as empty; tables without headers give no row.
    """
    packed = F.array_sort(F.collect_list(F.struct("col_id", F.coalesce("text", F.lit("")).alias("text"))))
    own = headers.groupBy("table_id").agg(packed.alias("names"))
    low = lambda x: F.lower(F.trim(x["text"]))
    dims = F.size(F.filter("names", lambda x: F.rtrim(low(x), F.lit(".")).isin(DIMENSION_CODES)))
    flow_words, points = F.size(F.filter("names", lambda x: _has(low(x), FLOW_WORDS))), F.size(F.filter("names", lambda x: is_flow_point(x["text"])))
    sized = F.exists("names", lambda x: _has(low(x), DIMENSION_WORDS)) & ~F.exists("names", lambda x: _has(low(x), PUMP_WORDS))
    own = own.withColumns({"grid": (flow_words >= 4) | (points >= 4), "_dims": dims, "_none": sized})

    def told(x: Column) -> Column:
        s = low(x)
        power = _has(s, POWER_WORDS)
        head = (_head(s) | ((s == "h") & (F.col("_dims") < 3))) & ~power
        return F.struct(x["col_id"].alias("col_id"), _has(s, MODEL_WORDS).alias("model"), (_has(s, FLOW_WORDS) & ~head & ~F.col("grid")).alias("q"), head.alias("h"), power.alias("kw"), _has(s, SPEED_WORDS).alias("rpm"), _has(s, HORSE_WORDS).alias("hp"))

    own = own.withColumn("_told", F.when(~F.col("_none"), F.transform("names", told)))

    def first(told: Column, flag: str, taken: Column) -> Column:
        """The first column with the flag that has no role yet."""
        return F.get(F.filter(told, lambda x: x[flag] & ~F.coalesce(F.array_contains(taken, x["col_id"]), F.lit(False))), F.lit(0))["col_id"]

    def roles(told: Column, found: list[Column], taken: Column) -> Column:
        if len(found) == len(ROLES):
            return F.struct(*(x.alias(role) for role, x in zip(ROLES, found, strict=True)))
        one = first(told, ROLES[len(found)].removesuffix("_col"), taken)
        return bound(one, lambda x: roles(told, [*found, x], F.array_compact(F.concat(taken, F.array(x)))))

    none = F.array().cast(f"array<{headers.schema['col_id'].dataType.simpleString()}>")
    own = once(own, bound("_told", lambda told: roles(told, [], none)), ["table_id", "grid", "names"])
    head = F.lower(F.get(F.filter("names", lambda x: x["col_id"] == F.col("h_col")), F.lit(0))["text"])
    return own.select("table_id", *ROLES, "grid", F.coalesce(_has(head, MILLIMETRES), F.lit(False)).alias("h_in_mm"), "names")


def power_of(text: Column) -> Column:
    """The number after 'kw', else the cell's own."""
    marked = F.regexp_extract(F.lower(text), r"(?:kw|квт)\s+([\d.,]+)", 1)
    return F.when(marked != "", parse_number_rich(marked)).otherwise(parse_number_rich(text))


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def flow_of_headers(names: Column, skip: Column) -> Column:
    """The flow that the first telling header of a grid names, m³/h: after 'm3/h', after 'l/min', or after a word of flows; else
    the second number of the first header like '20.1.2'. skip: array of column numbers that don't count."""
    free = F.filter(names, lambda x: ~F.array_contains(skip, x["col_id"]))
    number = lambda s, pattern: _positive(F.translate(F.regexp_extract(s, pattern, 1), ",", ".").try_cast("double"))

    def told(x: Column) -> Column:
        s = F.lower(F.trim(x["text"]))
        near = number(s, r"(?:q|flow|delivery|capacity)[^0-9]*(\d+[.,]?\d*)")
        return F.coalesce(number(s, r"m.?/h[)\s.]*(\d+[.,]?\d*)"), half_up(number(s, r"l/min[)\s.]*(\d+[.,]?\d*)") / 16.67, 1), F.when(near < 500, near))

    def pair(x: Column) -> Column:
        shape = r"^(\d+)[.](\d+[.]?\d*)[.]?(?:H=|$)"
        a, b = (F.regexp_extract(F.trim(x["text"]), shape, i).try_cast("double") for i in (1, 2))
        return F.when((b > 0.1) & (b < 200) & (a > b), b)

    first = lambda f: F.get(F.filter(F.transform(free, f), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(first(told), first(pair))


def row_records(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """table_id, row_id, model, q, h, kw, rpm (null where a row doesn't tell) and confidence_h of the rows of tables that have a
    model column and one of flow, head or power. cells: table_id, row_id, col_id, text; roles: column_roles().

    An empty flow in a grid comes from the headers; an empty power from the horse power; an empty head from the first other
    column of heads with a number over 0, in a grid also from the first flow point between .5 and 300; a power that is still
    empty from the head's cell (its number, so that head and power are then equal). Rows whose model has fewer than three
    characters are passed over. Rows meet the roles of their table in a join; a row's cells are gathered, a table's aren't.
    """
    whole = roles.where("model_col IS NOT NULL AND coalesce(q_col, h_col, kw_col) IS NOT NULL")
    rows = cells.groupBy("table_id", "row_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_id", F.coalesce("text", F.lit("")).alias("text"))))).alias("c"))
    met = rows.join(whole, "table_id")
    cell = lambda role: F.when(F.col(role).isNotNull(), F.try_element_at("c", F.col(role)))
    skip = F.array_compact(F.array("model_col", "q_col", "kw_col", "rpm_col", "hp_col"))
    met = met.withColumns({"_model": F.trim(cell("model_col")), "_skip": skip}).where(F.length("_model") >= 3)
    others = F.filter("names", lambda x: ~F.array_contains(F.col("_skip"), x["col_id"]))
    value = lambda x: parse_number_rich(F.try_element_at("c", x["col_id"]))
    by_word = F.get(F.filter(F.transform(F.filter(others, lambda x: _has(F.lower(x["text"]), OTHER_HEAD_WORDS)), value), lambda v: v > 0), F.lit(0))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x["text"])), "gpm|min|l|m|h", ""), r"[/\s.×,]", "")
    points = F.filter(others, lambda x: (F.length(F.trim(x["text"])) >= 3) & bare(x).rlike(r"^\d+$"))
    by_point = F.when(F.col("grid"), F.get(F.filter(F.transform(points, value), lambda v: (v > 0.5) & (v < 300)), F.lit(0)))
    known = lambda x: F.when(x != 0, x)
    met = met.withColumns({"_q": known(parse_number_rich(cell("q_col"))), "_h": known(parse_number_rich(cell("h_col"))), "_kw": known(power_of(cell("kw_col")))})
    q = F.coalesce("_q", F.when(F.col("grid"), flow_of_headers(F.col("names"), F.col("_skip"))))
    kw = F.coalesce("_kw", half_up(_positive(parse_number_rich(cell("hp_col"))) * HORSE_KW, 2), known(power_of(cell("h_col"))))
    return met.select(
        "table_id", "row_id", clean_raw_name(F.col("_model")).alias("model"), q.alias("q"), F.coalesce("_h", by_word, by_point).alias("h"), kw.alias("kw"), parse_number_rich(cell("rpm_col")).cast("int").alias("rpm"),
        F.when(F.col("h_in_mm"), 0.3).otherwise(0.6).alias("confidence_h"),
    ).where("model IS NOT NULL")


def header_records(roles: DataFrame) -> DataFrame:
    """The columns of row_records() for tables whose headers hide their first record behind dots, as 'Model.Model.TD32-14G/2' and
    'H [m].H [m].14': of each header the last part that is a model, or a number over 0. Tables need a model and a head column;
    a header without numbers gives no value. row_id is -1."""
    name = lambda role: F.get(F.filter("names", lambda x: x["col_id"] == F.col(role)), F.lit(0))["text"]
    parts = lambda role: F.reverse(F.transform(F.split(name(role), r"\."), lambda p: F.trim(p)))
    number = lambda role: F.get(F.filter(F.transform(parts(role), parse_number_rich), lambda v: v > 0), F.lit(0))
    model = F.get(F.filter(parts("model_col"), lambda p: p.rlike(MODEL_SHAPE)), F.lit(0))
    own = roles.where("model_col IS NOT NULL AND h_col IS NOT NULL").withColumn("_model", model).where("_model IS NOT NULL")
    kw = F.coalesce(number("kw_col"), half_up(number("hp_col") * HORSE_KW, 2))
    return own.select("table_id", F.lit(-1).alias("row_id"), clean_raw_name(F.col("_model")).alias("model"), number("q_col").alias("q"), number("h_col").alias("h"), kw.alias("kw"), F.lit(None).cast("int").alias("rpm"), F.lit(0.6).alias("confidence_h")).where("model IS NOT NULL")


def direct_records(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """key, model, q, h, kw (0 where nothing tells), confidence_h, table_id, row_id: a record for each model key over all tables,
    from hidden headers and rows, as the first of them names it. Of each value the surest one counts, the first of equals.
    Empty keys are dropped. Partial sums by key: each task sends a row on for each of its keys."""
    roles = column_roles(headers)
    rows = row_records(cells, roles)
    found = rows.unionByName(header_records(roles).withColumn("row_id", F.col("row_id").cast(rows.schema["row_id"].dataType)))
    found = found.withColumn("key", plain_key(F.col("model"))).where("key <> ''")
    surest = lambda x, doubt: F.min(F.when(F.col(x).isNotNull(), F.struct(doubt.alias("doubt"), "table_id", "row_id", F.col(x).alias("value"))))
    none, doubt = F.lit(0.0), -F.col("confidence_h")
    best = found.groupBy("key").agg(F.min(F.struct("table_id", "row_id", "model")).alias("first"), surest("q", none).alias("_q"), surest("h", doubt).alias("_h"), surest("kw", none).alias("_kw"))
    value = lambda x: F.coalesce(F.col(f"_{x}.value"), F.lit(0.0)).alias(x)
    return best.select("key", F.col("first.model").alias("model"), value("q"), value("h"), value("kw"), F.coalesce(-F.col("_h.doubt"), F.lit(0.0)).alias("confidence_h"), "first.table_id", "first.row_id")
