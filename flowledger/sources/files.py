"""Page texts, series bases and results as files that Spark reads and writes in any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "orc", "csv", "text")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = "source_file string, page_num long, text string") -> DataFrame:
    """source_file, page_num, text of decoded pages. Of text files each file is a page, named '<source>-<page>.txt'."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt != "text":
        reader = spark.read.schema(schema)
        return (reader.option("header", True).option("multiLine", True) if fmt == "csv" else reader).format(fmt).load(path)
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("name"))
    number = F.regexp_extract("name", r"-(\d+)\.[^.]*$", 1).try_cast("long")
    return raw.select(F.regexp_replace("name", r"-\d+\.[^.]*$", "").alias("source_file"), F.coalesce(number, F.lit(0)).alias("page_num"), "text")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def not_done(found: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """The first of each distinct content that isn't among the done ones."""
    order = [x for x in found.columns if x not in by]
    first = found.groupBy(*by).agg(F.min(F.struct(*order)).alias("f")).select(*by, *(F.col(f"f.{x}").alias(x) for x in order))
    return first.join(done.select(*by).distinct(), by, "left_anti").select(*found.columns)


BASE = "id string, kw double, q double, head_m double, orientation string, flagship boolean, brand string, confidence double"


def read_bases(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all series files of a folder; the series is what stands before '_base' in the file's name."""
    rows = spark.read.schema(BASE).option("multiLine", True).json(path)
    return rows.select("*", F.regexp_extract(F.upper(F.col("_metadata.file_name")), r"^([A-ZА-Я0-9]+)", 1).alias("series"))


def arrays_as_text(df: DataFrame) -> DataFrame:
    """Arrays joined by ';', as flat files need."""
    return df.withColumns({name: F.concat_ws(";", F.transform(name, lambda x: x.cast("string"))) for name, kind in df.dtypes if kind.startswith("array")})


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    arrays_as_text(df.select(*fields)).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def catalogue_documents(entries: DataFrame, by: str, order: list[str]) -> DataFrame:
    """One row for each catalogue: its records as an ordered array, and their number."""
    rest = [x for x in entries.columns if x != by]
    packed = F.array_sort(F.collect_list(F.struct(*order, *(x for x in rest if x not in order))))
    return entries.groupBy(by).agg(packed.alias("pumps"), F.count("*").alias("n_pumps"))


def valid_series(series: Column) -> Column:
    return series.rlike(r"^[A-Z]{2,5}\d?$")


def write_by_series(models: DataFrame, path: str, series: str = "series") -> None:
    """One folder for each well-formed series; rows of others aren't written."""
    good = models.where(valid_series(F.col(series)))
    good.repartition(series).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(series).parquet(path)


def replace_catalogues(new: DataFrame, path: str, by: str = "catalog") -> None:
    """Each catalogue in new takes the place of its former rows; other catalogues stay."""
    new.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def without_catalogue(rows: DataFrame, gone: DataFrame, by: str = "catalog") -> DataFrame:
    return rows.join(gone.select(by).distinct(), by, "left_anti")


FINAL = ("done", "failed", "cancelled")


def job_upsert(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after their updates (job_id, status, catalog_id, at): the last status counts, completed_at is set by a final one
    only, and a known catalog_id stays when an update has none."""
    last = updates.groupBy("job_id").agg(F.max(F.struct("at", "status")).alias("u"), F.max_by(F.struct("catalog_id"), F.when(F.col("catalog_id").isNotNull(), F.col("at")))["catalog_id"].alias("_catalog"))
    both = jobs.join(last, "job_id", "full")
    status = F.coalesce("u.status", "status")
    return both.select(
        "job_id",
        status.alias("status"),
        F.coalesce("_catalog", "catalog_id").alias("catalog_id"),
        F.when(F.col("u").isNotNull() & F.col("u.status").isin(*FINAL), F.col("u.at")).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def vision_records(payload: Column) -> Column:
    """array<struct(model, power_kw, q_points, h_points)> of a JSON answer {q_values, pumps: [{model, power_kw, h_values}]},
    which may stand in a code fence or among other text. Curves are cut to the shorter array; those of under two points are
    dropped, and so is an answer that isn't JSON."""
    body = F.regexp_extract(payload, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "q_values array<double>, pumps array<struct<model: string, power_kw: double, h_values: array<double>>>")
    n = lambda p: F.least(F.size(parsed["q_values"]), F.size(p["h_values"]))
    curve = lambda p: F.struct(p["model"].alias("model"), F.coalesce(p["power_kw"], F.lit(0.0)).alias("power_kw"), F.slice(parsed["q_values"], 1, n(p)).alias("q_points"), F.slice(p["h_values"], 1, n(p)).alias("h_points"))
    return F.filter(F.transform(parsed["pumps"], curve), lambda x: (F.size(x["h_points"]) >= 2) & (F.length(x["model"]) > 0))
