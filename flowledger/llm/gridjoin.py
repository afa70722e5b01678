"""Links between near-equal vectors by an epsilon grid order join, and their components.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2c) of each other, and so do their projections on any
orthonormal directions. Vectors are projected on the leading principal directions of all of them; their cells in a grid
of width eps there give the order in which each group's vectors are sorted over all partitions. Intervals of that
sequence form a tree, whose leaves are blocks of vectors. From the root of each group, pairs of intervals are joined
level by level: a pair goes on to the pairs of its parts unless their bounding boxes are further apart than eps. Blocks
that remain are joined in the same way, down to intervals of a few vectors, whose cosines are worked out.

Vectors that are equal stand for one with a weight. What leaves a pair of blocks is a count for each vector that has
links and a forest of the links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged
from .graph import connected_components, forest
from .grid import finite

#: Vectors in a block, and in the smallest interval that isn't split any more.
BLOCK, LEAF = 512, 16
#: Leading principal directions of the grid.
AXES = 8
#: Bits of an interval's number that one level of the tree takes off: parts of an interval number 2**BITS at most.
BITS = 4
#: Slack of distances, far over what rounding can shift them.
SLACK = 1e-9
#: Products of intervals that are worked out at once.
TILES = 512
#: Equal vectors that are more than this share of all rows, and than LEAST_HOT, meet their class by broadcast: there are at
#: most HOT_SHARE such classes.
HOT_SHARE, LEAST_HOT = 4_000, 200
CLASS = ["dims", "grp", "v"]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, grp, list of finite numbers) -> (vec_id, grp, dims, v): doubles, scaled by a power of two so that no square
    leaves their range. The cosines stay what they are."""
    for batch in batches:
        column = batch.column(2)
        sizes = column.value_lengths().to_numpy()
        flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
        rows = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            x = flat[a:b] + 0.0  # minus zero is zero
            rows.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(rows, pa.binary())], names=["vec_id", "grp", "dims", "v"])


def _units(column: pa.Array, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of neighbours of one length."""
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sizes)]]), strict=True):
        if a < b:
            yield int(sizes[a]), slice(int(a), int(b))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, v) -> the sum of u'u over a task's unit vectors, a row of it to a row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dims, own in _runs(batch.column(0).to_numpy()):
            u = _units(batch.column(1).slice(own.start, own.stop - own.start), dims)
            sums[dims] = sums.get(dims, 0) + u.T @ u
    for dims, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], names=["dims", "i", "row"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for dims, i, row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            sums[dims, i] = sums.get((dims, i), 0) + np.frombuffer(row, np.float64)
    for (dims, i), x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["dims", "i", "row"])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """By length of the vectors, the leading directions of all of them as columns. Tasks sum, then the rows of the sums meet;
    the driver gets one matrix for each length."""
    form = "dims int, i int, row binary"
    rows = classes.select("dims", "v").mapInArrow(_moments, form).repartition(partitions(classes.sparkSession), "dims", "i").mapInArrow(_summed, form).collect()
    out = {}
    for dims in {r["dims"] for r in rows}:
        m = np.stack([np.frombuffer(r["row"], np.float64) for r in sorted((r for r in rows if r["dims"] == dims), key=lambda r: r["i"])])
        out[dims] = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :AXES])
    return out


def _celled(axes: dict[int, np.ndarray], eps: float):
    """(cls, dims, grp, v, rep, weight) -> these with cells: the grid cell in bytes that sort as its numbers do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for dims, own in _runs(batch.column(1).to_numpy()):
                at = np.floor(_units(batch.column(3).slice(own.start, own.stop - own.start), dims) @ axes[dims] / eps)
                cells += [x.tobytes() for x in (at + 2**31).astype(">u4")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], names=[*batch.schema.names, "cells"])

    return run


def _blocks(axes: dict[int, np.ndarray]):
    """Sorted classes -> blocks of neighbours of one group, with their bounding boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def block(key: tuple, rows: list) -> pa.RecordBatch:
            nonlocal seq
            dims, grp = key
            cls, v, reps, weights = zip(*rows, strict=True)
            at = _units(pa.array(v, pa.binary()), dims) @ axes[dims]
            low, high = (np.pad(x, (0, AXES - len(x))) for x in (at.min(axis=0), at.max(axis=0)))
            seq += 1
            data = [np.array(x, np.int64).tobytes() for x in (cls, reps, weights)] + [b"".join(v)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq - 1], pa.int64()), pa.array([dims], pa.int32()), pa.array([grp]), *(pa.array([x], pa.binary()) for x in data), *(pa.array([x]) for x in (*low, *high))],
                names=["part", "seq", "dims", "grp", "cls", "reps", "weights", "v", *BOX],
            )

        key, held = None, []
        for batch in batches:
            for dims, grp, *row in zip(*(batch.column(c).to_pylist() for c in ("dims", "grp", "cls", "v", "rep", "weight")), strict=True):
                if held and ((dims, grp) != key or len(held) == BLOCK):
                    yield block(key, held)
                    held = []
                key = (dims, grp)
                held.append(row)
        if held:
            yield block(key, held)

    return run


BOX = [f"{end}{k}" for end in ("low", "high") for k in range(AXES)]
LINKS = "a long, b long, n long"


def near_intervals(blocks: DataFrame, eps: float) -> DataFrame:
    """(dims, grp, a, b): numbers of blocks of a group, a <= b, whose boxes are within eps. The tree is walked from the root,
    a join with the parts of both intervals for each level."""
    last = blocks.agg(F.max("number").alias("n")).first()["n"]
    depth = -(-int(last or 0).bit_length() // BITS)
    boxes = blocks.select("dims", "grp", "number", *BOX)

    def level(k: int) -> DataFrame:
        """The intervals that are k levels above blocks."""
        node = F.shiftright("number", BITS * k).alias("node")
        return boxes.groupBy("dims", "grp", node).agg(*((F.min if c.startswith("low") else F.max)(c).alias(c) for c in BOX))

    pairs = boxes.select("dims", "grp").distinct().select("dims", "grp", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    gap = reduce(lambda x, y: x + y, (F.pow(F.greatest(F.lit(0.0), F.col(f"b.low{k}") - F.col(f"a.high{k}"), F.col(f"a.low{k}") - F.col(f"b.high{k}")), F.lit(2)) for k in range(AXES)))
    for k in range(depth - 1, -1, -1):
        parts = level(k)
        parent = F.shiftright("node", BITS).alias("parent")
        side = lambda x: parts.select("dims", "grp", parent, "node", *BOX).alias(x)  # noqa: E731, B023
        of = lambda x: [F.col(f"{x}.{c}") == F.col(f"p.{c}") for c in ("dims", "grp")] + [F.col(f"{x}.parent") == F.col(f"p.{x}")]
        pairs = pairs.alias("p").join(side("a"), of("a")).join(side("b"), of("b")).where((F.col("a.node") <= F.col("b.node")) & (gap <= (eps + SLACK) ** 2))
        pairs = pairs.select("p.dims", "p.grp", F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return pairs


def _boxes(at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bounding boxes of the intervals of a block's projections, from the whole block down to LEAF rows."""
    out, span = [], BLOCK
    while span >= LEAF:
        cuts = np.arange(0, len(at), span)
        out.append((np.minimum.reduceat(at, cuts), np.maximum.reduceat(at, cuts)))
        span //= 2
    return out


def join_intervals(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, threshold: float, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of x and y, or i < j of x where y is None, with a cosine of at least threshold; x and y are sorted in grid
    order and have at most BLOCK rows. counts, if given, gets how many pairs were worked out."""
    same, y = y is None, x if y is None else y
    norms = [np.linalg.norm(z, axis=1) for z in (x, y)]
    boxes = [_boxes(z / n[:, None] @ axes) for z, n in zip((x, y), norms, strict=True)]
    reach = (np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK) ** 2
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level, ((low, high), (low2, high2)) in enumerate(zip(*boxes, strict=True)):
        if level:  # each interval has two parts; the last one may lack them
            i, j = ((np.repeat(z, 4) * 2 + np.tile(part, len(z))) for z, part in ((i, [0, 0, 1, 1]), (j, [0, 1, 0, 1])))
            there = (i < len(low)) & (j < len(low2)) & ((i <= j) | (not same))
            i, j = i[there], j[there]
        gap = np.maximum(0, np.maximum(low2[j] - high[i], low[i] - high2[j]))
        near = (gap * gap).sum(axis=1) <= reach
        i, j = i[near], j[near]
    tall = [np.full((-(-len(z) // LEAF) * LEAF, z.shape[1]), np.nan) for z in (x, y)]  # what is not a number is near nothing
    for t, z, n in zip(tall, (x, y), norms, strict=True):
        t[: len(z)] = z
    size = [np.concatenate([n, np.ones(len(t) - len(n))]).reshape(-1, LEAF) for n, t in zip(norms, tall, strict=True)]
    left, right = (t.reshape(-1, LEAF, t.shape[1]) for t in tall)
    found = []
    for a in range(0, len(i), TILES):
        p, q = i[a : a + TILES], j[a : a + TILES]
        cosines = left[p] @ right[q].transpose(0, 2, 1) / (size[0][p][:, :, None] * size[1][q][:, None, :])
        at, r, c = np.nonzero(cosines >= threshold)
        found.append((p[at] * LEAF + r, q[at] * LEAF + c))
    rows, columns = (np.concatenate(z) if found else np.empty(0, np.int64) for z in (zip(*found, strict=True) if found else ((), ())))
    if counts is not None:
        counts["looked"] = counts.get("looked", 0) + len(i) * LEAF * LEAF
    if same:
        upper = rows < columns
        rows, columns = rows[upper], columns[upper]
    return rows, columns


def _joined(axes: dict[int, np.ndarray], threshold: float):
    """Pairs of blocks -> LINKS: (class, null, what its linked vectors weigh) and (rep, rep, null) of a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                same, dims = r["a"] == r["b"], r["dims"]
                sides = [(*(np.frombuffer(r[f"{c}_{s}"], np.int64) for c in ("cls", "reps", "weights")), np.frombuffer(r[f"v_{s}"], np.float64).reshape(-1, dims)) for s in "ab"]
                (cls, reps, weights, x), (cls2, reps2, weights2, y) = sides
                i, j = join_intervals(x, None if same else y, axes[dims], threshold)
                if not len(i):
                    continue
                n, n2 = (np.zeros(len(z), np.int64) for z in (x, y))
                np.add.at(n, i, weights2[j])
                np.add.at(n2, j, weights[i])
                some, some2 = np.flatnonzero(n), np.flatnonzero(n2)
                low, high = forest(reps[i], reps2[j])
                none = lambda k: pa.nulls(k, pa.int64())
                for columns in ((cls[some], none(len(some)), n[some]), (cls2[some2], none(len(some2)), n2[some2]), (low, high, none(len(low)))):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, group: str | None = "label", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row: other vectors with a cosine of at least threshold (over 0, up to 1), the
    smallest vec_id that links reach from it, and whether that is its own.

    Only rows whose group is equal and not null, and whose vectors have one length, are compared; with group None all rows of
    one length. Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing, nor do
    rows without a group or vec_id. A row without vec_id has no component and is kept. vec_id is meant to be unique; rows that
    repeat one are vectors of their own, and share a component if theirs begin with it. An empty table gives none; other
    columns are ignored.
    """
    spark, n = vectors.sparkSession, partitions(vectors.sparkSession)
    eps = max(float(np.sqrt(max(0.0, 2 - 2 * threshold))), 1e-4)
    grp = F.lit("") if group is None else F.col(group).cast("string")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), grp.alias("grp"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = finite() & F.exists("embedding", lambda c: c != 0) & F.col("vec_id").isNotNull() & F.col("grp").isNotNull()
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    known = staged(rows.where("fine").select("vec_id", "grp", "embedding").mapInArrow(_vectors, "vec_id long, grp string, dims int, v binary"), "vectors")
    classes = known.groupBy(*CLASS).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("cls"), *CLASS, "rep", "weight"), "classes")
    axes = principal_axes(classes)

    # a cell that many vectors share is dealt by the vectors' hashes
    celled = classes.mapInArrow(_celled(axes, eps), "cls long, dims int, grp string, v binary, rep long, weight long, cells binary").withColumn("hash", F.xxhash64("v"))
    order = ["dims", "grp", "cells", "hash", "cls"]
    sequence = celled.repartitionByRange(n, *order).sortWithinPartitions(*order)
    form = "part long, seq long, dims int, grp string, cls binary, reps binary, weights binary, v binary, " + ", ".join(f"{c} double" for c in BOX)
    blocks = staged(sequence.mapInArrow(_blocks(axes), form), "blocks")
    width = 1 + int(blocks.agg(F.max("seq").alias("n")).first()["n"] or 0).bit_length()
    blocks = blocks.withColumn("number", F.shiftleft("part", width) + F.col("seq"))

    data = ["cls", "reps", "weights", "v"]
    side = lambda s: blocks.select("dims", "grp", F.col("number").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in data))
    pairs = near_intervals(blocks, eps).repartition(n, "dims", "grp", "a")
    met = pairs.join(side("a"), ["dims", "grp", "a"]).join(side("b"), ["dims", "grp", "b"])
    links = staged(met.select("dims", "a", "b", *(f"{c}_{s}" for s in "ab" for c in data)).mapInArrow(_joined(axes, threshold), LINKS), "links")

    counted = links.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("linked"))
    parts = connected_components(links.where("b is not null").select("a", "b")).select(F.col("vertex").alias("rep"), "component")
    result = classes.join(counted, "cls", "left").join(parts, "rep", "left")
    result = result.select(*CLASS, "rep", "weight", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    result = staged(result, "linked")

    # classes of one vector are rows already; the rows of the others meet their class, hot ones by broadcast
    many = result.where("weight > 1").select(*CLASS, "n_links", "component_id", (F.col("weight") > max(LEAST_HOT, known.count() // HOT_SHARE)).alias("hot"))
    hot = known.join(F.broadcast(many.where("hot").drop("hot")), CLASS, "left")
    rest = known.join(F.broadcast(many.where("hot").select(*CLASS)), CLASS, "left_anti").join(many.where("not hot").drop("hot"), CLASS)
    columns = ["vec_id", "n_links", "component_id"]
    out = result.where("weight = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id").unionByName(hot.where("n_links is not null").select(columns)).unionByName(rest.select(columns))
    out = out.unionByName(rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select(*columns, F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.a LEFT JOIN n ON e.vec_id = n.a
"""
