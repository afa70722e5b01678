"""Blocks of vectors, and a grid on which blocks of queries meet blocks of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged

#: Vectors in a row of candidates, and in a row of queries.
SHARD, QUERIES = 8192, 512
SCHEMA = "block long, dims int, ids binary, labels binary, data binary"


def finite(embedding: str = "embedding"):
    """Whether a vector is there and so are all its components, none of them infinite or not a number."""
    x = F.col(embedding)
    return F.coalesce(x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def _packed(size: int):
    """Batches of (vec_id, label, v) -> rows of SCHEMA of at most size vectors of one length; block is a number of its own
    for each row, with ten free bits above size for the place of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        block = TaskContext.get().partitionId() << 32

        def row(dims: int, parts: list) -> pa.RecordBatch:
            nonlocal block
            block += 1
            columns = [np.concatenate(x).tobytes() for x in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([dims], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], names=["block", "dims", "ids", "labels", "data"])

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy()
            flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                rows = flat[ends[at][:, None] + np.arange(dims)].reshape(len(at), dims)
                for a in range(0, len(at), size):
                    own = at[a : a + size]
                    room = size - sum(len(x) for x, _, _ in held.get(dims, []))
                    for part in (slice(0, room), slice(room, None)):
                        if len(own[part]):
                            held.setdefault(dims, []).append((ids[own[part]], labels[own[part]], rows[a : a + size][part]))
                        if sum(len(x) for x, _, _ in held.get(dims, [])) == size:
                            yield row(dims, held.pop(dims))
        for dims, parts in held.items():
            yield row(dims, parts)

    return run


def blocks(vectors: DataFrame, size: int, n: int, label: str) -> DataFrame:
    """vectors (vec_id long, label long, v array<double>) as rows of SCHEMA, staged: which vectors share a block depends
    on the order in which they arrive, so a second try must not make other blocks."""
    return staged(vectors.select("vec_id", "label", "v").repartition(n).mapInArrow(_packed(size), SCHEMA), label)


def meet(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """Each row of asked with each row of shards of the same dims; columns of asked begin with query_ (but dims and block).

    Both are laid out on a grid: a block of queries goes to all columns of its row, a block of candidates to all rows of
    its column, and each cell is joined by its own key. The grid has about four cells for each shuffle partition and at
    most the square root of that many rows, so candidates aren't copied more often when there are more queries: a row
    then has several blocks of them.
    """
    n = partitions(asked.sparkSession)
    rows = max(1, min(asked.count(), round((4 * n) ** 0.5)))
    columns = max(1, 4 * n // rows)
    place, every = (lambda k: F.pmod(F.xxhash64("block"), F.lit(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    own = [c if c in ("dims", "block") else F.col(c).alias(f"query_{c}") for c in asked.columns]
    asked = asked.select(*own, place(rows).alias("row"), every(columns).alias("column"))
    shards = shards.select("dims", "ids", "labels", "data", place(columns).alias("column"), every(rows).alias("row"))
    return asked.join(shards, ["row", "column", "dims"])
