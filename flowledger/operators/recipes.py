"""Extraction templates: how well they did, what becomes of them, and which catalogue each fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.names import series_of
from ..functions.numbers import half_up
from .wordscan import MAX_WORDS, words_in


def histories(outcomes: DataFrame) -> DataFrame:
    """Each use of a recipe with uses, successes and consecutive failures so far, in order of ts and event_id."""
    order = Window.partitionBy("recipe_id").orderBy("ts", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = outcomes.withColumns({"uses": F.row_number().over(order).cast("long"), "successes": F.sum(F.col("success").cast("long")).over(upto)})
    last_win = F.coalesce(F.max(F.when(F.col("success"), F.col("uses"))).over(upto), F.lit(0))
    return counted.withColumn("failures", F.col("uses") - last_win)


def action(uses: Column, successes: Column, failures: Column) -> Column:
    """delete, promote, demote or ok."""
    rate = successes / uses
    return F.when((failures >= 3) | ((uses >= 3) & (rate < 0.5)), "delete").when((uses >= 3) & (rate >= 0.9), "promote").when((uses >= 3) & (rate < 0.7), "demote").otherwise("ok")


def evaluate(outcomes: DataFrame) -> DataFrame:
    """Where each recipe stands after all its uses, and the action that follows."""
    last = histories(outcomes).groupBy("recipe_id").agg(F.max_by(F.struct("uses", "successes", "failures"), F.struct("ts", "event_id")).alias("s"))
    return last.select("recipe_id", "s.*").withColumn("action", action(F.col("uses"), F.col("successes"), F.col("failures")))


def adjusted_confidence(confidence: Column, act: Column) -> Column:
    """Promotion adds .05 (to .99), demotion takes .10 (to .10)."""
    return F.when(act == "promote", F.least(confidence + 0.05, F.lit(0.99))).when(act == "demote", F.greatest(confidence - 0.10, F.lit(0.10))).otherwise(confidence)


def _catalogues(entries: DataFrame) -> DataFrame:
    ok = F.col("reason") == "ok"
    low = F.min(F.when(F.col("q_nom") > 0, F.col("q_nom"))) * 0.8
    return physics.with_checks(entries).groupBy("source_file").agg(
        F.count("*").alias("n"), half_up(F.avg("confidence"), 9).alias("mean"), F.avg(ok.cast("double")).alias("rate"), F.concat_ws(",", F.sort_array(F.collect_set(series_of(F.col("model"))))).alias("series"), low.alias("q_low"), (F.max("q_nom") * 1.2).alias("q_high")
    )


def successes(entries: DataFrame, confidence: float = 0.8, physics_rate: float = 0.8) -> DataFrame:
    """source_file, success: a record at least, the mean confidence and the valid share are high enough."""
    return _catalogues(entries).withColumn("success", (F.col("n") >= 1) & (F.col("mean") >= confidence) & (F.col("rate") >= physics_rate))


def generate(entries: DataFrame, confidence: float = 0.8, physics_rate: float = 0.8, least: int = 3) -> DataFrame:
    """A recipe for each catalogue that was read well: recipe_id, source_file, series, q_low, q_high."""
    good = _catalogues(entries).where((F.col("n") >= least) & (F.col("mean") >= confidence) & (F.col("rate") >= physics_rate))
    return good.select(F.substring(F.md5(F.concat(F.lit("auto_"), "source_file")), 1, 12).alias("recipe_id"), "source_file", "series", "q_low", "q_high")


def glob_regex(pattern: Column) -> Column:
    """A file name pattern with * and ? as a regular expression."""
    quoted = F.regexp_replace(F.lower(pattern), r"([.\\+^$()\[\]{}|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def fragment(pattern: Column) -> Column:
    """The longest piece of a file name pattern between its wildcards, the first of equals; empty without one."""
    pieces = F.split(F.lower(pattern), r"[*?]+")
    return F.array_min(F.transform(pieces, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))["p"]


def _by_name(files: DataFrame, recipes: DataFrame) -> DataFrame:
    """source_file, recipe_id of the file names that fit a recipe's pattern: those that hold the pattern's longest fragment are
    found by one automaton of all fragments and then held against the whole pattern. A pattern of wildcards alone fits all that
    are long enough, so its recipes are dealt to every file."""
    own = recipes.where("file_pattern IS NOT NULL").select("recipe_id", "file_pattern", fragment(F.col("file_pattern")).alias("term"))
    named = files.select("source_file", F.lower("source_file").alias("_low"))
    found = words_in(named, "_low", own.select("term")).join(own.where("term <> ''"), "term").select("source_file", "recipe_id", "file_pattern")
    wild = own.where("term = ''").agg(F.collect_list(F.struct("recipe_id", "file_pattern")).alias("wild"))
    if wild.where("size(wild) > 0").isEmpty():
        every = found.limit(0)
    else:
        rows = wild.first()["wild"]
        if len(rows) > MAX_WORDS:
            raise ValueError(f"over {MAX_WORDS} patterns without a letter")
        every = files.select("source_file", F.explode(F.array(*(F.struct(F.lit(r["recipe_id"]).alias("recipe_id"), F.lit(r["file_pattern"]).alias("file_pattern")) for r in rows))).alias("r")).select("source_file", "r.*")
    fits = F.regexp_like(F.lower("source_file"), glob_regex(F.col("file_pattern")))
    return found.unionByName(every).where(fits).select("source_file", "recipe_id").distinct()


def match(pages: DataFrame, recipes: DataFrame, least: float = 50.0) -> DataFrame:
    """The best recipe of each catalogue that reaches the least score, the smaller id among equals.

    pages: source_file, text, a row for each page. recipes: recipe_id, file_pattern, keywords (array), signatures (array),
    confidence, failures and, if known, producer: 100 for the file name, 50 for each keyword, 30 for each signature and 20
    for the producer that any page has. An automaton of all words reads each page once and only the words found go on, so no
    catalogue's text is joined and no recipe is held against a page. The words are sent to the workers, as many as words_in()
    allows; more are an error.
    """
    term = lambda column, points: recipes.select("recipe_id", F.explode(column).alias("term"), F.lit(points).alias("points"))
    terms = term("keywords", 50).union(term("signatures", 30))
    if "producer" in recipes.columns:
        terms = terms.union(term(F.array("producer"), 20))
    terms = terms.select("recipe_id", F.lower("term").alias("term"), "points").where("term <> ''")
    found = words_in(pages.select("source_file", F.lower("text").alias("_low")), "_low", terms.select("term")).select("source_file", "term").distinct()
    by_text = found.join(terms, "term").groupBy("source_file", "recipe_id").agg(F.sum("points").alias("t"))
    by_name = _by_name(pages.select("source_file").distinct(), recipes).withColumn("f", F.lit(100))
    both = by_text.join(by_name, ["source_file", "recipe_id"], "full").join(recipes.select("recipe_id", "failures", "confidence"), "recipe_id")
    score = (F.coalesce("t", F.lit(0)) + F.coalesce("f", F.lit(0))) * F.when(F.col("failures") >= 3, 0.3).when(F.col("failures") >= 2, 0.6).otherwise(1.0) * (F.lit(0.5) + F.col("confidence") * 0.5)
    scored = both.select("source_file", "recipe_id", score.alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("source_file").agg(F.min(F.struct((-F.col("score")).alias("s"), "recipe_id")).alias("b"))
    return best.select("source_file", "b.recipe_id", (-F.col("b.s")).alias("score"))


def within_budget(pages: DataFrame, by: str, order: list[Column], cost: float, most_cost: float, most_pages: int) -> DataFrame:
    """The pages of each catalogue, in order, as long as their cost and number stay within the limits."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return pages.withColumn("place", place).where((F.col("place") <= most_pages) & (F.col("place") * cost <= most_cost))
