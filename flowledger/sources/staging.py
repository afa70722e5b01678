"""Tables that a plan writes and reads again in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a local session has none, one beside its warehouse; a cluster must name one."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), f"_staged-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage and plan end here."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
