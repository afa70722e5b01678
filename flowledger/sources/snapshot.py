"""Catalogues that are replaced whole: rows by batch, and manifests that say which batch of a catalogue counts.

A batch writes its rows into a folder of its own, then a new manifest, and becomes visible when that manifest takes its number,
by one rename. A reader takes the highest manifest and sees a batch wholly or not at all; a batch that broke off before the
rename is in no manifest, and a second try of one that is in a manifest changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """(the file system of a path, a maker of its paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests, ascending; none for a new folder."""
    fs, make = _files(spark, path)
    folder = make(f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, by: str, version: int | None = None) -> DataFrame:
    """by and batch of each catalogue as of a version, the last if none is given; a row with null by has the last batch."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], f"{by} string, batch long")
    return spark.read.schema(f"{by} string, batch long").parquet(f"{path}/manifest/{known[-1] if version is None else version:010d}")


def write_rows(new: DataFrame, path: str, batch: int, by: str = "catalog") -> None:
    """The rows of a batch, in order of their catalogues so that files can be passed over; in no manifest yet."""
    new.withColumn(by, F.col(by).cast("string")).where(F.col(by).isNotNull()).repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(f"{path}/rows/batch={batch:010d}")


def replace_catalogues(new: DataFrame, path: str, batch: int, by: str = "catalog") -> bool:
    """Each catalogue in new takes the place of its former rows; other catalogues stay. Rows with a null catalogue are left out.
    False, and nothing done, if a manifest has this batch or a later one. Batches come one at a time, in ascending order;
    if another manifest takes the number meanwhile, this raises, and the batch can be tried again."""
    spark = new.sparkSession
    before = manifest(spark, path, by)
    last = before.agg(F.max("batch").alias("b")).first()["b"]
    if last is not None and last >= batch:
        return False
    write_rows(new, path, batch, by)
    own = spark.read.parquet(f"{path}/rows/batch={batch:010d}").select(by).distinct().withColumn("batch", F.lit(batch).cast("long"))
    after = before.where(F.col(by).isNotNull()).join(own.select(by), by, "left_anti").unionByName(own).unionByName(spark.range(1).select(F.lit(None).cast("string").alias(by), F.lit(batch).cast("long").alias("batch")))
    number = (versions(spark, path) or [0])[-1] + 1
    fs, make = _files(spark, path)
    draft, place = f"{path}/manifest/_draft-{uuid.uuid4().hex}", make(f"{path}/manifest/{number:010d}")
    after.coalesce(1).write.parquet(draft)
    if fs.exists(place) or not fs.rename(make(draft), place):
        raise RuntimeError(f"manifest {number} was taken meanwhile")
    return True


def read_catalogues(spark: SparkSession, path: str, schema, by: str = "catalog", version: int | None = None) -> DataFrame:
    """The rows of all catalogues as of a version, the last if none is given. schema: of the rows, with by as a string."""
    live = manifest(spark, path, by, version).where(F.col(by).isNotNull())
    if not versions(spark, path):
        return spark.createDataFrame([], schema)
    columns = spark.createDataFrame([], schema).columns
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(live, [by, "batch"], "left_semi").select(*columns)
