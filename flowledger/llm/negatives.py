"""Hard negatives of anchors by a secondary-sort shuffle.

Blocks of anchors meet blocks of all rows twice. The first time each cell keeps every anchor's first rows of the same
label; the best of these over all cells are its positives, each of which has a window of scores. The second time each
cell keeps, for every window of an anchor, the first rows of other labels whose scores lie in it. So what is shuffled is
a few rows for each anchor and cell, not a row for each pair.

Both kinds of pairs are keyed by (anchor, descending score, kind, id), dealt by anchor and sorted by the whole key within
the partitions. A streaming iterator reads them: a positive opens its window, a negative goes to every open window that
holds its score and isn't full. It keeps the windows of one anchor, however many rows the anchor has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .grid import QUERIES, SHARD, blocks, finite, meet
from .maxscore import EXACT

POSITIVE, NEGATIVE = 0, 1
PAIRS = "anchor long, down long, kind int, id long, anchor_id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, a row for each query; beyond 64 bits the nearest 64-bit integer."""
    if max(1, vectors.shape[1]) * max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(vectors).max(initial=0)) < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    top = 2**63 - 1
    wide = np.vectorize(int, otypes=[object])
    return np.array([[max(-top - 1, min(top, int(x))) for x in row] for row in wide(queries) @ wide(vectors).T], np.int64).reshape(len(queries), len(vectors))


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers x with low * score <= 100 * x <= high * score; the window is empty if the first is the greater."""
    return -(-low * score // 100), high * score // 100


def _first(scores: np.ndarray, ids: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores among those that which marks, ties by the smaller id."""
    at = np.flatnonzero(which)
    if len(at) > 4 * k:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _cell(k: int, low: int, high: int, kind: int):
    """Rows of meet() -> PAIRS. Positives: each anchor's first k of its label. Negatives: the first k of each window, which
    query_windows has as (place of the anchor, positive score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in ("block", "dims", "query_ids", "query_labels", "query_data", "ids", "labels", "data")}
                query_ids, query_labels, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("query_ids", "query_labels", "ids", "labels"))
                queries, vectors = (np.frombuffer(r[c], np.float64).reshape(n, r["dims"]) for c, n in (("query_data", len(query_ids)), ("data", len(ids))))
                windows: dict[int, set] = {}
                for w in batch.column("query_windows")[row].as_py() if kind == NEGATIVE else ():
                    windows.setdefault(w["place"], set()).add(window(w["score"], low, high))
                out: list = []
                for a in range(0, len(queries), 64):
                    for q, own in enumerate(scores_of(queries[a : a + 64], vectors), a):
                        same = labels == query_labels[q]
                        if kind == POSITIVE:
                            at = _first(own, ids, same & (ids != query_ids[q]), k)
                        else:
                            found = [_first(own, ids, ~same & (own >= lo) & (own <= hi), k) for lo, hi in windows.get(q, ()) if lo <= hi]
                            at = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
                        if len(at):
                            out.append((np.full(len(at), (r["block"] << 10) + q), ~own[at], np.full(len(at), kind, np.int32), ids[at], np.full(len(at), query_ids[q])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["anchor", "down", "kind", "id", "anchor_id"])

    return run


def _sorted(pairs: DataFrame) -> DataFrame:
    """Dealt by anchor, sorted by the whole key within each partition."""
    return pairs.repartition(partitions(pairs.sparkSession), "anchor").sortWithinPartitions("anchor", "down", "kind", "id")


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _first_of_each(k: int):
    """Sorted pairs -> each anchor's first k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, n = None, 0
        for batch in batches:
            keep = []
            for at, x in enumerate(batch.column("anchor").to_pylist()):
                anchor, n = (anchor, n + 1) if x == anchor else (x, 1)
                if n <= k:
                    keep.append(at)
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def _mined(k: int, low: int, high: int):
    """Sorted pairs -> MINED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows, out = None, [], []  # a window: positive id, its score, lowest and highest score, rows so far

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in MINED.split(", ")])

        for x, down, kind, own, anchor_id in _rows(batches, ["anchor", "down", "kind", "id", "anchor_id"]):
            score = ~down
            if x != anchor:
                anchor, windows = x, []
            if kind == POSITIVE:
                windows.append([own, score, *window(score, low, high), 0])
                continue
            for w in windows:
                if w[4] < k and w[2] <= score <= w[3]:
                    w[4] += 1
                    out.append((anchor_id, w[0], w[4], own, w[1], score))
            if len(out) >= 10_000:
                yield rows()
                out = []
        if out:
            yield rows()

    return run


def mine(anchors: DataFrame, candidates: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchors and candidates: (vec_id long, label long, v array<double> of whole numbers) -> MINED.

    An anchor's positives are its first n_positives candidates of its label by inner product, ties by the smaller vec_id,
    without its own vec_id (all, if fewer). For each of them the first n_negatives candidates of another label with low *
    positive_score <= 100 * negative_score <= high * positive_score, in the same order; rank counts from 1 among these.
    An anchor without positives, or a positive whose window holds nothing, gives no row; so do empty tables.

    Rows with a null in any column take no part. Candidates of another length than the anchor's aren't seen by it.
    Repeated rows of a vec_id are anchors and candidates each. Other columns are ignored.
    """
    n = partitions(candidates.sparkSession)
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    asked = blocks(anchors.where(whole), QUERIES, max(1, n // 4), "anchors")
    shards = blocks(candidates.where(whole), SHARD, n, "shards")
    positives = _sorted(meet(asked, shards).mapInArrow(_cell(n_positives, low, high, POSITIVE), PAIRS)).mapInArrow(_first_of_each(n_positives), PAIRS)
    # at most n_positives windows for each vector of a block
    place, score = F.expr("anchor & 1023"), F.expr("~down")
    windows = positives.groupBy(F.expr("anchor >> 10").alias("block")).agg(F.collect_list(F.struct(place.alias("place"), score.alias("score"))).alias("windows"))
    negatives = meet(asked.join(windows, "block"), shards).mapInArrow(_cell(n_negatives, low, high, NEGATIVE), PAIRS)
    return _sorted(positives.unionByName(negatives)).mapInArrow(_mined(n_negatives, low, high), MINED)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(finite() & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * 256).cast("double")).alias("v"))
    return mine(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP13_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM fine a JOIN fine c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
) WHERE rank <= 3
"""
