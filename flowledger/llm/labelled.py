"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bound on labelled rows that a classifier is fitted on. They come to the driver as numbers, never as text.
MAX_LABELLED = 10_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: F.Column, features: F.Column, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label, features) of at most limit labelled documents, those with the smallest hash of doc_id.

    Rows without doc_id or label are left out; of repeated labels of one document the greatest counts, of its repeated
    rows the one with the least features. The sample's ids are broadcast: limit bounds them.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).where("doc_id is not null and label is not null")
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(F.broadcast(ids), "doc_id").select("doc_id", "label", features.alias("features")).groupBy("doc_id", "label").agg(F.min("features").alias("features"))
