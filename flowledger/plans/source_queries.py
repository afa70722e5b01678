"""Queries over sources, sinks, jobs and their streaming twins' batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names
from ..operators import merge
from ..sources import files, snapshot
from ..sources.staging import shared_dir
from ..streaming import jobs
from . import oracle as O
from .inputs import ENTRIES, entries, table
from .registry import query


@query("s2_fingerprint_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 50 AND text IS NOT NULL) GROUP BY 2")
def _(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return files.not_done(docs, docs.where("doc_id < 50"), ["sha256"])


@query("s6_catalogue_documents", f"WITH {ENTRIES} SELECT source_file, count(*) AS n_pumps, arg_min(model, seq) AS first_model FROM entries GROUP BY source_file")
def _(spark, d):
    docs = files.catalogue_documents(entries(spark, d).select("source_file", "seq", "model", "q_nom", "h_nom"), "source_file", ["seq"])
    return docs.select("source_file", "n_pumps", F.get("pumps", F.lit(0))["model"].alias("first_model"))


@query("s7_arrays_as_text", "SELECT o_custkey, string_agg(o_orderkey::varchar, ';' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def _(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))
    return files.arrays_as_text(o)


@query(
    "s8_upsert_by_key",
    f"""WITH {ENTRIES}, k AS (SELECT {O.key()} AS key, seq, model, q_nom, h_nom, confidence, data_source FROM entries), o AS (SELECT * FROM k WHERE data_source = 'estimated'), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, q_nom DESC) AS r FROM k WHERE data_source = 'catalog_curve' AND q_nom > 30)
    SELECT seq, model, q_nom FROM o WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT seq, model, q_nom FROM n WHERE r = 1""",
)
def _(spark, d):
    own = entries(spark, d).select("seq", "model", "q_nom", "data_source")
    old, new = own.where("data_source = 'estimated'").drop("data_source"), own.where("data_source = 'catalog_curve' AND q_nom > 30").drop("data_source")
    return merge.upsert(old, new, names.model_key(F.col("model")), [F.col("seq"), F.col("q_nom")])


@query("s10_delete_catalog", f"WITH {ENTRIES} SELECT seq, source_file FROM entries WHERE source_file NOT IN (SELECT concat('s', s_suppkey::varchar) FROM supplier WHERE s_suppkey % 4 = 0)")
def _(spark, d):
    gone = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_file"))
    return files.without_catalogue(entries(spark, d).select("seq", "source_file"), gone, "source_file")


@query("s11_partition_by_series", f"WITH {ENTRIES}, s AS (SELECT {O.series()} AS series, count(*) AS n FROM entries GROUP BY 1) SELECT * FROM s WHERE regexp_matches(series, '^[A-Z]{{2,5}}\\d?$')")
def _(spark, d):
    counts = entries(spark, d).groupBy(names.series_of(F.col("model")).alias("series")).agg(F.count("*").alias("n"))
    return counts.where(files.valid_series(F.col("series")))


@query(
    "s12_job_upsert",
    """WITH u AS (SELECT user_id AS job_id, event_type AS status, epoch_us(ts) AS tm FROM events),
    l AS (SELECT job_id, status, tm FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tm DESC, CASE WHEN status = 'error' THEN 'failed' ELSE status END DESC) AS r FROM u) WHERE r = 1),
    j AS (SELECT c_custkey AS job_id, 'new' AS status FROM customer)
    SELECT job_id, coalesce(l.status, j.status) AS status, CASE WHEN l.status = 'error' THEN l.tm END AS completed_at FROM j FULL JOIN l USING (job_id)""",
)
def _(spark, d):
    e = table(spark, d, "events")
    updates = e.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("catalog_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.lit("new").alias("status"), F.col("c_custkey").alias("catalog_id"), F.lit(None).cast("long").alias("completed_at"))
    out = files.job_upsert(known, updates)
    return out.select("job_id", F.when(F.col("status") == "failed", "error").otherwise(F.col("status")).alias("status"), "completed_at")


@query("m3_retention", "SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= (SELECT TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 DAY) GROUP BY ALL")
def _(spark, d):
    return jobs.retained(table(spark, d, "events"), "ts", "2024-01-15 00:00:00", 10).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("m3_fresh_tasks", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return jobs.fresh_tasks(table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("f21_vision_json", "SELECT p_partkey, concat('CDM ', p_size::varchar) AS model, p_size * 0.5::DOUBLE AS power_kw, 2 AS n_points FROM part")
def _(spark, d):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit('Here:\n```json\n{"q_values": [1, 2, 3], "pumps": [{"model": "CDM '), size, F.lit('", "power_kw": '), (F.col("p_size") * 0.5).cast("string"), F.lit(', "h_values": [9, 8]}, {"model": "x", "h_values": [1]}]}\n```'))
    rows = table(spark, d, "part").select("p_partkey", F.explode(files.vision_records(text)).alias("r"))
    return rows.select("p_partkey", "r.model", "r.power_kw", F.size("r.h_points").alias("n_points"))


@query("f20_json_from_text", "SELECT event_id, coalesce(json_extract_string(props, '$.page'), '') AS page FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.lit("")).alias("page"))


ROWS = "catalog string, model string, q double, at long"


@query(
    "s9_replace_catalogues",
    """SELECT 's' || l_suppkey AS catalog, concat('m', l_partkey) AS model, max(l_quantity) AS q, 1 AS "at" FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY ALL UNION ALL SELECT 's' || l_suppkey, concat('n', l_linenumber), max(l_quantity), 2 FROM lineitem WHERE l_suppkey % 3 = 0 AND l_suppkey % 2 = 0 GROUP BY ALL UNION ALL SELECT 's' || l_suppkey, concat('m', l_partkey), max(l_quantity), 1 FROM lineitem WHERE l_suppkey % 3 = 0 AND l_suppkey % 2 <> 0 GROUP BY ALL""",
)
def _(spark, d):
    """All catalogues, a third of them replaced or done twice, and a batch that broke off before it was in a manifest."""
    line = table(spark, d, "lineitem")
    name = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("catalog")
    of = lambda rows, letter, column, at: rows.groupBy(name, F.concat(F.lit(letter), F.col(column).cast("string")).alias("model")).agg(F.max("l_quantity").alias("q")).withColumn("at", F.lit(at).cast("long"))
    path = f"{shared_dir(spark)}/catalogues-{uuid.uuid4().hex}"
    snapshot.replace_catalogues(of(line, "m", "l_partkey", 1), path, 1)
    some = of(line.where("l_suppkey % 3 = 0 AND l_suppkey % 2 = 0"), "n", "l_linenumber", 2)
    for _ in range(2):
        snapshot.replace_catalogues(some, path, 2)
    snapshot.write_rows(of(line, "x", "l_partkey", 3), path, 3)
    return snapshot.read_catalogues(spark, path, ROWS)


@query(
    "m1_incremental_upsert",
    """WITH x AS (SELECT 's' || l_suppkey AS catalog, concat('m', l_partkey) AS model, max(l_quantity) AS q, l_linenumber AS arrival FROM lineitem WHERE l_suppkey % 7 >= l_linenumber % 7 GROUP BY ALL) SELECT catalog, model, q, CAST(arrival AS BIGINT) AS "at" FROM x WHERE arrival = (SELECT max(arrival) FROM x y WHERE y.catalog = x.catalog)""",
)
def _(spark, d):
    """Line numbers are arrivals of whole catalogues, which replace their former rows; the stream looks thrice."""
    line = table(spark, d, "lineitem").where("l_suppkey % 7 >= l_linenumber % 7")
    rows = line.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("catalog"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("model"), F.col("l_linenumber").cast("long").alias("at")).agg(F.max("l_quantity").alias("q")).select("catalog", "model", "q", "at")
    folder = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    for k in (1, 4, 7):
        rows.where(F.col("at").between(k, k + 2)).write.parquet(f"{folder}/in/part-{k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        jobs.upsert_snapshot(stream, f"{folder}/out", f"{folder}/state").start().awaitTermination()
    return snapshot.read_catalogues(spark, f"{folder}/out", ROWS)
