"""Joining several records of one model, gap filling and donors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import model_key, series_of
from ..functions.numbers import half_up

ORDER = ("seq", "q_nom", "h_nom", "confidence")
#: Completeness points of each field; confidence is added. A curve counts 3.
POINTS = {"q_nom": 1.0, "h_nom": 1.0, "power_kw": 1.0, "rpm": 0.5, "article": 0.5, "stages": 0.3, "dn_suction": 0.3}
#: What a merge takes from the first record that knows it.
NUMBERS, TEXTS = ("q_nom", "h_nom", "power_kw", "rpm", "stages", "dn_suction", "dn_discharge"), ("article", "series", "voltage")


def _knows(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False)) if df.schema[name].dataType.typeName() == "string" else F.coalesce(F.col(name) > 0, F.lit(False))


def _has_curve() -> Column:
    return F.coalesce((F.size("q_points") >= 3) & (F.size("h_points") >= 3), F.lit(False))


def completeness(df: DataFrame) -> Column:
    """Points for known fields plus the confidence."""
    score = F.col("confidence")
    for name, points in POINTS.items():
        if name in df.columns:
            score = score + F.when(_knows(df, name), points).otherwise(0.0)
    if "q_points" in df.columns:
        score = score + F.when(_has_curve(), 3.0).otherwise(0.0)
    return score


def cross_page_merge(entries: DataFrame, number: str = "seq") -> DataFrame:
    """One row for each model key: key, model, those of NUMBERS, TEXTS, q_points and h_points that entries have, confidence,
    n_pages (records merged).

    The records of a key are ranked by completeness, then by their number, then by flow; each field is the first known one in
    that rank (numbers over 0, texts that aren't empty, a curve of three points), 0 or null without; the confidence is the
    greatest. Records without a key are dropped. number is a whole number that tells the records apart.

    Records are summed up by their written model and completeness first, with numbers alone in the buffers, so this is a hash
    aggregation and a hot model costs each task a row or two; keys are worked out for those sums, not for each record. The pages
    themselves are rows of merged_pages.
    """
    numbers, texts = ([x for x in own if x in entries.columns] for own in (NUMBERS, TEXTS))
    order = F.col(number).cast("decimal(19,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + F.floor(F.coalesce("q_nom", F.lit(0.0)) * 100).cast("decimal(12,0)")
    ranked = entries.withColumns({"_lack": -half_up(completeness(entries), 6), "_order": order})
    by = ["model", "_lack"]
    keyed = lambda sums: sums.withColumn("key", model_key(F.col("model"))).where("key <> ''")
    # small methods: the JVM doesn't compile a large one, so the orders of the known values are columns before they are summed
    ordered = ranked.withColumns({f"_at_{x}": F.when(_knows(entries, x), F.col("_order")) for x in numbers})
    own = [c for x in numbers for c in (F.min_by(x, f"_at_{x}").alias(x), F.min(f"_at_{x}").alias(f"_at_{x}"))]
    sums = keyed(ordered.groupBy(*by).agg(*own, F.min("_order").alias("_at"), F.max("confidence").alias("confidence"), F.count("*").alias("n_pages")))
    first = lambda x, at: F.min_by(x, F.when(F.col(at).isNotNull(), F.struct("_lack", at))).alias(x)
    filled = [F.coalesce(first(x, f"_at_{x}"), F.lit(0)).cast(entries.schema[x].dataType).alias(x) for x in numbers]
    out = sums.groupBy("key").agg(first("model", "_at"), *filled, F.max("confidence").alias("confidence"), F.sum("n_pages").alias("n_pages"))
    for x in texts:
        told = keyed(ranked.where(_knows(entries, x)).groupBy(*by, x).agg(F.min("_order").alias("_at")))
        out = out.join(told.groupBy("key").agg(first(x, "_at")), "key", "left")
    if "q_points" in entries.columns:
        with_curve = ranked.where(_has_curve())
        best = keyed(with_curve.groupBy(*by).agg(F.min("_order").alias("_order"))).groupBy("key").agg(F.min(F.struct("_lack", "_order", "model")).alias("b"))
        best = best.select("key", "b.*").join(with_curve.select(*by, "_order", "q_points", "h_points"), [*by, "_order"]).dropDuplicates(["key"])
        out = out.join(best.select("key", "q_points", "h_points"), "key", "left")
    return out.select("key", "model", *numbers, *texts, *(x for x in ("q_points", "h_points") if x in entries.columns), "confidence", "n_pages")


def merged_pages(entries: DataFrame, by: tuple[str, ...] = ("source_file", "source_page")) -> DataFrame:
    """key, by, n: a row for each page that gave records to a model of two records or more, however many there are."""
    pages = entries.withColumn("key", model_key(F.col("model"))).where("key <> ''").groupBy("key", *by).agg(F.count("*").alias("n"))
    several = pages.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    return pages.join(several, "key", "left_semi")


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order. Groups are found by partial minima, not by sorting."""
    rest = [x for x in df.columns if x not in by]
    packed = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(F.col(x) for x in rest))
    return df.groupBy(*by).agg(F.min(packed).alias("first")).select(*by, *(F.col(f"first.{x}").alias(x) for x in rest))


def majority_fill(entries: DataFrame, column: str = "rpm", least: int = 2) -> DataFrame:
    """Missing (0 or null) values take the most common known one of their series, the smallest among equals; groups of
    fewer than least records stay as they are. Counts first, then a join with one row for each series."""
    own = entries.withColumn("series_key", F.when(series_of(F.col("model")) == "", "unknown").otherwise(series_of(F.col("model"))))
    counts = own.groupBy("series_key", column).agg(F.count("*").alias("n"))
    known = F.when(F.col(column) > 0, F.struct((-F.col("n")).alias("n"), F.col(column).alias("value")))
    best = counts.groupBy("series_key").agg(F.sum("n").alias("size"), F.min(known)["value"].alias("majority")).where(F.col("size") >= least)
    filled = F.when(F.coalesce(F.col(column), F.lit(0)) > 0, F.col(column)).otherwise(F.coalesce("majority", F.col(column)))
    return own.join(best, "series_key", "left").withColumn(f"{column}_filled", filled).drop("size", "majority")


def merge_value(d: Column, v: Column, o: Column, agreement: float = 0.05) -> Column:
    """struct(value, confidence, source) of three sources d, v and o (0 or null: missing)."""
    d, v, o = (F.coalesce(x, F.lit(0.0)) for x in (d, v, o))
    agree = lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) <= agreement
    pick = lambda x, c, s: F.struct(x.alias("value"), F.lit(c).alias("confidence"), F.lit(s).alias("source"))
    hd, hv, ho = d > 0, v > 0, o > 0
    return (
        F.when(hd & hv & ho & agree(d, v) & agree(d, o), pick(d, 1.0, "docling+vlm+ocr"))
        .when(hd & hv & ho & agree(d, o), pick(d, 0.8, "docling+ocr"))
        .when(hd & hv & ho & agree(v, o), pick(v, 0.7, "vlm+ocr"))
        .when(hd & hv & ho & agree(d, v), pick(d, 0.8, "docling+vlm"))
        .when(hd & hv & ho, pick(o, 0.4, "ocr(conflict)"))
        .when(hd & hv & agree(d, v), pick(d, 0.8, "docling+vlm"))
        .when(hd & hv, pick(d, 0.5, "docling(conflict)"))
        .when(hd & ho & agree(d, o), pick(d, 0.8, "docling+ocr"))
        .when(hd & ho, pick(o, 0.5, "ocr(conflict)"))
        .when(hv & ho & agree(v, o), pick(v, 0.7, "vlm+ocr"))
        .when(hv & ho, pick(o, 0.5, "ocr(conflict)"))
        .when(hd, pick(d, 0.6, "docling"))
        .when(hv, pick(v, 0.5, "vlm"))
        .when(ho, pick(o, 0.5, "ocr"))
        .otherwise(pick(F.lit(0.0), 0.0, ""))
    )


def merge_sources(left: DataFrame, middle: DataFrame, right: DataFrame, values: list[str], key: str = "key", order: str = "seq") -> DataFrame:
    """Full outer join of three sources by key (the last row of a key counts in each), merged value by value."""
    last = lambda df: df.groupBy(key).agg(*(F.max_by(x, order).alias(x) for x in values))
    d, v, o = (last(df).select(key, *(F.col(x).alias(f"{s}_{x}") for x in values)) for s, df in (("d", left), ("v", middle), ("o", right)))
    both = d.join(v, key, "full").join(o, key, "full")
    return both.select(key, *(merge_value(*(F.col(f"{s}_{x}") for s in "dvo")).alias(x) for x in values))


def fill_from(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left rows with missing values (0 or null) taken from the right row of their key (unique there)."""
    joined = left.join(right.select(key, *(F.col(x).alias(f"_{x}") for x in values)), key, "left")
    known = lambda x: F.when(F.col(x) > 0, F.col(x))
    return joined.withColumns({x: F.coalesce(known(x), known(f"_{x}"), F.col(x)) for x in values}).drop(*(f"_{x}" for x in values))


def rank_pair_join(left: DataFrame, right: DataFrame, by: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Inside equal keys, the i-th row of the left with the i-th of the right."""
    number = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return left.withColumn("rank", number(left_order)).join(right.withColumn("rank", number(right_order)), [*by, "rank"])


def prefixes(key: Column, least: int = 2) -> Column:
    """array: all prefixes of a key of at least so many characters. Turns a prefix join into an equi join."""
    return F.when(F.length(key) >= least, F.transform(F.sequence(F.lit(least), F.length(key)), lambda n: F.substring(key, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def suffixes(key: Column, least: int = 1) -> Column:
    """array: all proper suffixes of a key of at least so many characters."""
    n = F.length(key)
    return F.when(n > least, F.transform(F.sequence(F.lit(2), n - least + 1), lambda i: F.substring(key, i, n))).otherwise(F.array().cast("array<string>"))


def prefix_join(models: DataFrame, groups: DataFrame, key: str = "key", prefix: str = "prefix") -> DataFrame:
    """Each model with the group of the longest prefix that its key starts with."""
    dealt = models.select(key, F.explode(prefixes(F.col(key))).alias(prefix)).distinct()
    found = dealt.join(groups, prefix)
    rest = [x for x in groups.columns if x != prefix]
    best = found.groupBy(key).agg(F.max(F.struct(F.length(prefix).alias("_size"), F.col(prefix), *rest)).alias("best"))
    return models.join(best.select(key, F.col(f"best.{prefix}").alias(prefix), *(F.col(f"best.{x}").alias(x) for x in rest)), key, "left")


def drop_suffix_twins(models: DataFrame, key: str, complete: Column) -> DataFrame:
    """Without the incomplete rows whose key is a proper suffix of a complete row's key."""
    whole = models.where(complete).select(F.explode(suffixes(F.col(key))).alias(key)).distinct()
    return models.where(complete).unionByName(models.where(~complete).join(whole, key, "left_anti"))


def donor_fill(rows: DataFrame, by: str, is_donor: Column, needs: Column, score: Column, values: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows in need take the values of the best donor of their group: the highest score, the first in order."""
    best = rows.where(is_donor).groupBy(by).agg(F.min(F.struct((-score).alias("s"), *order, *(F.col(x).alias(f"_{x}") for x in values))).alias("d"))
    joined = rows.join(best.select(by, *(F.col(f"d._{x}").alias(f"_{x}") for x in values)), by, "left")
    take = needs & F.coalesce(*(F.col(f"_{x}") for x in values)).isNotNull()
    return joined.withColumns({x: F.when(take, F.col(f"_{x}")).otherwise(F.col(x)) for x in values} | {"from_donor": F.coalesce(take, F.lit(False))}).drop(*(f"_{x}" for x in values))


def alternate_fill(rows: DataFrame, key: str, alternates: Column, values: list[str]) -> DataFrame:
    """Missing values from other keys, tried in order. alternates: array of struct(key, confidence). rows have one row for
    each key. Returns rows with the values filled and <value>_fill_confidence."""
    wanted = rows.select(key, F.posexplode(alternates).alias("priority", "alt")).select(key, "priority", F.col("alt.key").alias("_alt"), F.col("alt.confidence").alias("_conf"))
    given = rows.select(F.col(key).alias("_alt"), *(F.col(x).alias(f"_{x}") for x in values))
    found = wanted.join(given, "_alt")
    best = found.groupBy(key).agg(*(F.min(F.when(F.col(f"_{x}") > 0, F.struct("priority", F.col(f"_{x}").alias("value"), "_conf"))).alias(f"_{x}") for x in values))
    joined = rows.join(best, key, "left")
    for x in values:
        lacks = F.coalesce(F.col(x), F.lit(0)) <= 0
        joined = joined.withColumn(f"{x}_fill_confidence", F.when(lacks, F.col(f"_{x}._conf"))).withColumn(x, F.when(lacks, F.coalesce(F.col(f"_{x}.value"), F.col(x))).otherwise(F.col(x)))
    return joined.drop(*(f"_{x}" for x in values))


def append_new_only(known: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """known, and the first new row of each key that known doesn't have."""
    return known.unionByName(first_per_key(new.join(known.select(key).distinct(), key, "left_anti"), [key], order).select(*known.columns))


def upsert(old: DataFrame, new: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """New rows replace the old ones of their key; of several new rows of a key the last in order counts; rows with an
    empty or null key are dropped. Doing it twice gives the same as once."""
    keyed = lambda df: df.withColumn("_key", key).where("_key <> ''")
    columns = old.columns
    latest = keyed(new).groupBy("_key").agg(F.max(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(F.col(x) for x in columns))).alias("r"))
    latest = latest.select("_key", *(F.col(f"r.{x}").alias(x) for x in columns))
    return keyed(old).join(latest.select("_key"), "_key", "left_anti").unionByName(latest).drop("_key")
