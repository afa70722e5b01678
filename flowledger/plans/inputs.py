"""Catalogue tables derived from the given tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a key to four tasks for each core. A small file is read in one task; what makes many rows of each of its
    rows would run in that task alone. The number is given, since Spark joins small partitions of its own number again."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


#: Rows that a task gets on average where rows are dealt out by their number.
ROWS_OF_A_TASK = 2**18


def tasks_for(rows: DataFrame) -> int:
    """How many tasks get ROWS_OF_A_TASK rows each, one for each core at least. The rows of a file are counted by its footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_OF_A_TASK))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each extracted model record; seq, q_nom, h_nom and confidence together order the rows."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    both = line.join(part, line["l_partkey"] == part["p_partkey"])
    slip = F.when(F.col("l_discount") == 0.1, 60.0).when(F.col("l_discount") == 0.0, 0.1).otherwise(1.0)
    power = F.floor(F.col("l_quantity") * F.col("l_extendedprice") / 367000 / (F.lit(0.40) + 5 * F.col("l_tax")) * slip * 100) / 100
    return both.select(
        (F.col("l_orderkey") * 10000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.substring("p_type", 1, 2), F.lit(" "), F.col("p_size").cast("string"), F.lit("-"), (F.col("l_partkey") % 20).cast("string")).alias("model"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_file"),
        (F.col("l_orderkey") % 50).alias("source_page"),
        F.col("l_quantity").alias("q_nom"),
        (F.floor(F.col("l_extendedprice") / 100) / 10).alias("h_nom"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(power).alias("power_kw"),
        F.when(F.col("l_linenumber") % 3 == 0, 0).when(F.col("p_size") % 2 == 0, 2900).otherwise(1450).alias("rpm"),
        F.when(F.col("l_returnflag") == "R", "estimated").when(F.col("l_returnflag") == "A", "catalog_nominal").otherwise("catalog_curve").alias("data_source"),
        (F.lit(0.5) + F.col("l_linenumber") * 0.05).alias("confidence"),
    )


ENTRIES = """entries AS (
  SELECT l_orderkey*10000000000 + l_partkey*100000 + l_suppkey*10 + l_linenumber AS seq,
    concat(substr(p_type,1,2),' ',p_size::varchar,'-',(l_partkey % 20)::varchar) AS model,
    concat('s', l_suppkey::varchar) AS source_file, l_orderkey % 50 AS source_page,
    l_quantity AS q_nom, floor(l_extendedprice/100)/10 AS h_nom,
    CASE WHEN l_linenumber = 7 THEN 0.0::DOUBLE
      ELSE floor(l_quantity*l_extendedprice/367000/(0.40::DOUBLE+5*l_tax)
        * CASE WHEN l_discount=0.1::DOUBLE THEN 60.0::DOUBLE WHEN l_discount=0.0::DOUBLE THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END * 100)/100 END AS power_kw,
    CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN p_size % 2 = 0 THEN 2900 ELSE 1450 END AS rpm,
    CASE l_returnflag WHEN 'R' THEN 'estimated' WHEN 'A' THEN 'catalog_nominal' ELSE 'catalog_curve' END AS data_source,
    0.5::DOUBLE + l_linenumber*0.05::DOUBLE AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, q, h: long Q-H curves, with some upward jumps of h."""
    line = table(spark, sf_dir, "lineitem")
    jump = F.when((F.col("l_discount") == 0.1) & (F.col("l_linenumber") <= 2), 150).otherwise(0)
    return line.groupBy(F.col("l_partkey").alias("model_id"), F.col("l_quantity").alias("q")).agg((F.max(1200 - 18 * F.col("l_quantity") + jump) / 10).alias("h"))


CURVE_POINTS = """curve_points AS (
  SELECT l_partkey AS model_id, l_quantity AS q,
    max(1200 - 18*l_quantity + CASE WHEN l_discount=0.1::DOUBLE AND l_linenumber<=2 THEN 150 ELSE 0 END)/10 AS h
  FROM lineitem GROUP BY l_partkey, l_quantity)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and the values of three sources that don't always agree (0: missing)."""
    line = table(spark, sf_dir, "lineitem")
    off = lambda m, k, step: F.col("l_quantity") * (1 + (F.col("l_partkey") % m - k) * step)
    return line.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.max("l_quantity").alias("d_q"),
        F.max(F.when(F.col("l_suppkey") % 5 == 0, 0.0).otherwise(off(7, 3, 0.02))).alias("v_q"),
        F.max(F.when(F.col("l_suppkey") % 3 == 0, 0.0).otherwise(off(5, 2, 0.03))).alias("o_q"),
    )


SOURCES = """sources AS (
  SELECT l_orderkey AS key, max(l_quantity) AS d_q,
    max(CASE WHEN l_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE l_quantity*(1+(l_partkey % 7 - 3)*0.02::DOUBLE) END) AS v_q,
    max(CASE WHEN l_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE l_quantity*(1+(l_partkey % 5 - 2)*0.03::DOUBLE) END) AS o_q
  FROM lineitem GROUP BY l_orderkey)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, row_id, col_id, text: table cells with decimal commas, dealt out by table and row. The tasks grow in number with
    the line items, not in memory; hardly two of these share a cell, so nothing is aggregated before they are dealt out."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_partkey").alias("row_id"), F.col("l_linenumber").alias("col_id"), "l_quantity")
    grouped = line.repartition(tasks_for(line), "table_id", "row_id").groupBy("table_id", "row_id", "col_id").agg(F.max("l_quantity").alias("x"))
    return grouped.select("table_id", "row_id", "col_id", F.translate(F.col("x").cast("decimal(10,1)").cast("string"), ".", ",").alias("text"))


CELLS = """cells AS (
  SELECT l_suppkey AS table_id, l_partkey AS row_id, l_linenumber AS col_id,
    replace(cast(cast(max(l_quantity) as decimal(10,1)) as varchar),'.',',') AS text
  FROM lineitem GROUP BY l_suppkey, l_partkey, l_linenumber)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe_id, event_id, ts, success: uses of recipes in time order."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recipe_id"), "event_id", "ts", (F.col("event_type") != "error").alias("success"))


OUTCOMES = "outcomes AS (SELECT user_id AS recipe_id, event_id, ts, event_type <> 'error' AS success FROM events)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, page_num, text: documents as page texts."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page_num"), "text")


PAGES = "pages_in AS (SELECT source AS source_file, doc_id AS page_num, text FROM documents)"
