"""Exact top-k inner products by MaxScore over blocks of postings.

Every dimension is a term; its postings are the vectors' components. For a query q, term d gives a vector v the
contribution q_d * v_d - least_d >= 0, where least_d is the least such product in the shard, and at most
bound_d = greatest_d - least_d. Terms are ordered by bound; as many of the lowest as together can't lift a vector over
the query's threshold (its k-th best score so far) are non-essential. The essential postings are traversed block by
block; a vector whose score from them plus all non-essential bounds is still competitive is probed in the
non-essential terms, highest bound first, until it can't win any more. Shards keep their k best, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions
from .grid import QUERIES, SHARD, blocks, finite, meet

#: Vectors traversed between two looks at the thresholds.
STEP = 1024
#: Integers up to here are exact as doubles; beyond, scores are worked out as Python integers.
EXACT = 2**53


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= cut
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search_exact(queries, query_ids, vectors, ids, k):
    """Any size of integers; a score beyond 64 bits counts as the nearest 64-bit integer."""
    wide, top = vectors.astype(object), 2**63 - 1
    for q, own in zip(queries.astype(object), query_ids, strict=True):
        scores = sorted(((-max(-top - 1, min(top, int(s))), int(i)) for s, i in zip(wide @ q, ids, strict=True) if i != own))[:k]
        yield np.array([-s for s, _ in scores], np.int64), np.array([i for _, i in scores], np.int64)


def search_shard(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, counts: dict | None = None):
    """For each query (scores, ids) of its k best vectors of the shard, itself (by id) left out. queries and vectors are
    doubles that hold integers, a row each. counts, if given, gets how many components were looked at."""
    dims = vectors.shape[1]
    if not len(vectors) or dims == 0:
        for own in query_ids:
            kept = np.sort(ids[ids != own])[:k] if dims == 0 else np.empty(0, np.int64)
            yield np.zeros(len(kept), np.int64), kept
        return
    if dims * max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(vectors).max()) >= EXACT:
        yield from _search_exact(queries, query_ids, vectors, ids, k)
        return
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    postings = np.ascontiguousarray(vectors.T)  # a row for each term
    looked = 0
    for q, own in zip(queries, query_ids, strict=True):
        least, most = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
        floor, bound = least.sum(), most - least
        terms = np.argsort(bound, kind="stable")  # ascending bound
        reach = np.concatenate([[0.0], np.cumsum(bound[terms])])  # what the first so many terms can add at most
        scores, found = np.empty(0), np.empty(0, np.int64)
        threshold = -np.inf
        for a in range(0, len(ids), STEP):
            block = slice(a, min(a + STEP, len(ids)))
            # a vector that only reaches the threshold can still win by its id
            n_rest = int(np.searchsorted(reach, threshold - floor, side="left")) - 1 if threshold > -np.inf else 0
            n_rest = max(0, min(n_rest, dims))
            rest, essential = terms[:n_rest], terms[n_rest:]
            if len(essential) == 0:
                break  # no vector of the shard can reach the threshold
            partial = q[essential] @ postings[essential, block]
            looked += len(essential) * partial.size
            # partial + the greatest that the others can give
            rest_most = reach[n_rest] + least[rest].sum()
            alive = np.flatnonzero(partial + rest_most >= threshold)
            for t in rest[::-1]:
                if not len(alive):
                    break
                partial[alive] += q[t] * postings[t, a + alive]
                looked += len(alive)
                rest_most -= most[t]
                alive = alive[partial[alive] + rest_most >= threshold]
            own_ids = ids[block][alive]
            keep = own_ids != own
            scores, found = _best(np.concatenate([scores, partial[alive][keep]]), np.concatenate([found, own_ids[keep]]), k)
            if len(scores) == k:
                threshold = scores[-1]
        yield scores.astype(np.int64), found
    if counts is not None:
        counts["looked"] = counts.get("looked", 0) + looked
        counts["all"] = counts.get("all", 0) + vectors.size * len(queries)


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component, for rows whose vector and components are all finite."""
    fine = finite() & F.col("vec_id").isNotNull()
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))


def _search_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("dims", "query_ids", "query_data", "ids", "data")]
            for dims, query_ids, query_data, ids, data in zip(*columns, strict=True):
                query_ids, ids = np.frombuffer(query_ids, np.int64), np.frombuffer(ids, np.int64)
                queries, vectors = (np.frombuffer(x, np.float64).reshape(n, dims) for x, n in ((query_data, len(query_ids)), (data, len(ids))))
                own, found, scores = [], [], []
                for q, (s, i) in zip(query_ids, search_shard(queries, query_ids, vectors, ids, k), strict=True):
                    own.append(np.full(len(i), q))
                    found.append(i)
                    scores.append(s)
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (own, found, scores)], names=["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """queries and candidates: (vec_id, v array<double> of integers) -> query_id, rank (from 1), vec_id, score: the k
    highest inner products of each query (all, if fewer), ties to the smaller vec_id, without the query's own vec_id.

    Vectors of another length than the query's are no candidates; vectors without components score 0. Repeated rows of a
    vec_id are candidates each. Scores beyond 64 bits count as the nearest 64-bit integer. No queries: no rows.

    Queries and candidates are packed into blocks that meet on a grid (grid.meet), so the stated queries meet all
    vectors, with no row for a pair of vectors and nothing broadcast. Blocks of both sides are staged.
    """
    n = partitions(queries.sparkSession)
    queries, candidates = (x.withColumn("label", F.lit(0).cast("long")) for x in (queries, candidates))
    asked, shards = blocks(queries, QUERIES, max(1, n // 4), "queries"), blocks(candidates, SHARD, n, "shards")
    found = meet(asked, shards).mapInArrow(_search_rows(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


OP6_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
