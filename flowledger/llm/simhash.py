"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has one or more 64-bit words. For a radius, structured bit masks are made so that two fingerprints that
differ in at most so many bits agree on all bits of at least one mask: bit i gets a vector m(i) of r + 1 bits, and mask
v keeps the bits whose m(i) has an odd number of bits in common with v. Any r of the bits leave some v that keeps
none of them (Pagh, "CoverLSH", 2016). A larger radius is dealt out over blocks of bits, of which one must have its
share of the differences at most.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import id_or_last, partitions, slices, staged, text_bytes
from .graph import connected_components, forest
from .prints import majority_bits

#: A group of more fingerprints than this is split by further masks.
GROUP_LIMIT = 256
SIGN = 1 << 63


# ---------------------------------------------------------------- fingerprints


def fingerprints(texts: list[bytes], width: int = 3, seeds: tuple[int, ...] = (42,)) -> np.ndarray:
    """A row of fingerprint words for each text: SimHash of the XXH64 of its width-word shingles, one word for each seed.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+, repeats count; a text of fewer words is one shingle; a text
    without words has fingerprint zero.
    """
    shingles, starts = [], [0]
    for text in texts:
        words = text.lower().split()
        if len(words) >= width:
            shingles += map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        elif words:
            shingles.append(b" ".join(words))
        starts.append(len(shingles))
    out = np.zeros((len(texts), len(seeds)), np.uint64)
    for k, seed in enumerate(seeds):
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in shingles), np.uint64, len(shingles))
        out[:, k] = majority_bits(hashes, np.array(starts))
    return out


def fingerprint_column(text: str = "text", width: int = 3, seeds: tuple[int, ...] = (42,)):
    """array<long>: the fingerprint words of a text column (null text: zero)."""

    @F.arrow_udf("array<long>")
    def words(column: pa.Array) -> pa.Array:
        texts = text_bytes(column)
        rows = [fingerprints(texts[a:b], width, seeds) for a, b in slices([len(x) for x in texts], 1 << 20)]
        flat = np.concatenate(rows).view(np.int64).ravel() if rows else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(seeds)), pa.array(flat))

    return words(F.col(text))


# ---------------------------------------------------------------- masks


def block_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bits, of which each pair that differs in at most radius of them agrees on one.

    The vectors of the first radius + 1 bits are 1, 2, 4, ..., so with more than radius bits no mask is zero.
    """
    units = [1 << k for k in range(radius + 1)]
    order = units + [v for v in range(1, 2 ** (radius + 1)) if v not in units]
    vectors = [order[j % len(order)] for j in range(len(bits))]
    masks = [sum(1 << b for b, m in zip(bits, vectors, strict=True) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    return sorted(set(masks))


def signed(x: int) -> int:
    return x - 2**64 if x >= SIGN else x


def first_masks(n_words: int, blocks: int, radius: int) -> list[tuple[int, int, int]]:
    """(word, block, mask): each word is cut into blocks of bits, each of which covers the radius."""
    size = 64 // blocks
    return [(w, b, m) for w in range(n_words) for b in range(blocks) for m in block_masks(list(range(b * size, (b + 1) * size)), radius)]


def finer(word: int, block: int, mask: int, blocks: int, radius: int) -> list[int]:
    """For a group that agrees on mask: masks that also fix some of the block's other bits. None when at most
    4 * (radius + 1) bits are free: further masks make ever more copies of rows that agree on most bits by now, and
    a pair can differ in radius of them anyway. Such a group is compared whole."""
    size = 64 // blocks
    free = [i for i in range(block * size, (block + 1) * size) if not mask >> i & 1]
    return [mask | m for m in block_masks(free, radius)] if len(free) > 4 * (radius + 1) else []


# ---------------------------------------------------------------- links


def close_forest(words: np.ndarray, ids: np.ndarray, distance: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A forest over ids that joins what links at distance or fewer differing bits, compared tile by tile."""
    n = len(ids)
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, n, tile):
        left = words[i : i + tile]
        for j in range(i, n, tile):
            right = words[j : j + tile]
            apart = sum(np.bitwise_count(left[:, None, w] ^ right[None, :, w]).astype(np.uint16) for w in range(words.shape[1]))
            x, y = np.nonzero(apart <= distance)
            if i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                a, b = forest(np.concatenate([a, ids[i + x]]), np.concatenate([b, ids[j + y]]))
    return a, b


def _small_groups(distance: int, n_words: int):
    """Streams the groups of a partition sorted by (table, key); gives their forests."""

    def of(keys: list[np.ndarray], pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(pdf[[f"w{i}" for i in range(n_words)]].to_numpy(np.int64)).view(np.uint64)
        ids = pdf["id"].to_numpy(np.int64)
        change = np.ones(len(pdf), bool)
        change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(pdf)))
        found_a, found_b = [], []
        for lag in range(1, min(8, len(pdf))):  # small groups at once: each row against its next few
            same = np.flatnonzero(np.arange(len(pdf) - lag) + lag < np.repeat(starts + sizes, sizes)[: len(pdf) - lag])
            same = same[np.repeat(sizes <= 8, sizes)[same]]
            if len(same):
                apart = np.bitwise_count(words[same] ^ words[same + lag]).sum(axis=1)
                hit = same[apart <= distance]
                found_a.append(ids[hit])
                found_b.append(ids[hit + lag])
        for s, k in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            a, b = close_forest(words[s : s + k], ids[s : s + k], distance)
            found_a.append(a)
            found_b.append(b)
        return forest(np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, np.int64),) * 2

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            table, key = pdf["table"].to_numpy(), pdf["key"].to_numpy()
            last = np.flatnonzero((table != table[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                a, b = of([table[:cut], key[:cut]], pdf[:cut])
                yield pd.DataFrame({"a": a, "b": b})
            held = pdf[cut:].reset_index(drop=True)
        if held is not None and len(held):
            a, b = of([held["table"].to_numpy(), held["key"].to_numpy()], held)
            yield pd.DataFrame({"a": a, "b": b})

    return run


def links(prints: DataFrame, n_words: int, distance: int, radius: int, blocks: int = 1, limit: int = GROUP_LIMIT) -> DataFrame:
    """prints: id long, w0.. long, all rows different in their words. Edges (a, b) of forests whose components are those
    of the links at distance or fewer bits, as far as the masks cover them: with blocks * n_words blocks of bits and a
    radius for each, all pairs at up to blocks * n_words * (radius + 1) - 1 bits.

    A group of over limit fingerprints is dealt out by finer masks again and again, until it is small or few bits
    of its block are free (see finer). So no group is compared whole while it can be split, and none is cut short.
    """
    spark = prints.sparkSession
    names = [f"w{i}" for i in range(n_words)]
    todo = [(w, b, m) for w, b, m in first_masks(n_words, blocks, radius)]
    rows = prints
    found = []
    while True:
        tables = {key: i for i, key in enumerate(dict.fromkeys(todo))}
        groups = F.array(*(F.struct(F.lit(i).alias("table"), F.col(names[w]).bitwiseAND(F.lit(signed(m))).alias("key")) for (w, _, m), i in tables.items()))
        if rows is prints:
            dealt = prints.withColumn("g", F.explode(groups)).select("g.table", "g.key", "id", *names)
        else:
            dealt = rows
        sizes = dealt.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
        large = sizes.where(F.col("size") > limit)
        oversized = [r["table"] for r in large.select("table").distinct().collect()]  # at most one row for each mask
        by_table = {i: key for key, i in tables.items()}
        splits = {i: masks for i in oversized if (masks := [m for m in finer(*by_table[i], blocks, radius) if m != by_table[i][2]])}
        small = dealt
        if splits:
            small = dealt.join(large.where(F.col("table").isin(list(splits))), ["table", "key"], "left_anti")
        n = partitions(spark)
        found.append(small.repartition(n, "table", "key").sortWithinPartitions("table", "key").mapInPandas(_small_groups(distance, n_words), "a long, b long"))
        if not splits:
            break
        again = dealt.join(large.where(F.col("table").isin(list(splits))).select("table", "key"), ["table", "key"], "left_semi")
        todo = [(by_table[i][0], by_table[i][1], m) for i, masks in splits.items() for m in masks]
        following = {key: j for j, key in enumerate(dict.fromkeys(todo))}
        of = [
            F.when(F.col("table") == i, F.array(*(F.struct(F.lit(following[by_table[i][0], by_table[i][1], m]).alias("table"), F.col(names[by_table[i][0]]).bitwiseAND(F.lit(signed(m))).alias("key")) for m in masks)))
            for i, masks in splits.items()
        ]
        rows = staged(again.withColumn("g", F.explode(F.coalesce(*of))).select("g.table", "g.key", "id", *names).distinct(), "simhash-split")
    return reduce(DataFrame.union, found)


def _vertex(n_words: int):
    """The fingerprint itself where it is one word, else a hash of its words."""
    return F.col("words")[0] if n_words == 1 else F.xxhash64("words")


def _classes(printed: DataFrame, n_words: int, distance: int, radius: int, blocks: int) -> DataFrame:
    """printed: doc_id, words. Returns id (a fingerprint's vertex), component (the smallest vertex of its class) and
    component_id (the smallest doc_id of its class)."""
    names = [f"w{i}" for i in range(n_words)]
    distinct = printed.groupBy("words").agg(F.min("doc_id").alias("least"))
    distinct = staged(distinct.select(_vertex(n_words).alias("id"), *(F.col("words")[i].alias(x) for i, x in enumerate(names)), "least"), "simhash-distinct")
    edges = links(distinct.select("id", *names), n_words, distance, radius, blocks)
    reached = staged(connected_components(edges), "simhash-components")
    least = distinct.join(reached, distinct["id"] == reached["vertex"]).groupBy("component").agg(F.min("least").alias("component_id"))
    joined = reached.join(least, "component").select(F.col("vertex").alias("id"), "component", "component_id")
    return distinct.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, seeds: tuple[int, ...] = (42,), distance: int = 3, radius: int | None = None, blocks: int = 1) -> DataFrame:
    """docs with doc_id and text -> doc_id, words (the fingerprint, array<long>), component_id.

    component_id is the smallest doc_id that can be reached over links of at most distance differing bits, itself
    included. radius is that of each of blocks blocks in each fingerprint word (default: what covers distance).

    Null text counts as empty; documents without words have fingerprint zero and link like any other. Repeated rows each
    get a row. A null doc_id stays null; it never names a component unless all members are null, when it is null. An
    empty table gives an empty one. Other columns of docs are ignored.
    """
    n_words = len(seeds)
    radius = distance // (blocks * n_words) if radius is None else radius
    printed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column("text", width, seeds).alias("words")), "simhash")
    classes = _classes(printed, n_words, distance, radius, blocks)
    return printed.withColumn("id", _vertex(n_words)).join(classes, "id", "left").select("doc_id", "words", "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each class of near duplicates: the smallest doc_id
    (a null one counts as the largest; among rows of one doc_id the one with the smallest text hash). Of equal rows one
    stays.

    Documents link where the sets of their shingles of width words have a Jaccard similarity of 0.8 or more. All such links are
    found and each is held against the whole sets, see shingles: documents meet by covering masks of their fingerprints,
    and, as fingerprints at 0.8 differ in a seventh of their bits on average, on shingles too.
    """
    key = {"_k": id_or_last(), "_t": F.xxhash64("text")}
    own = docs.withColumns(key)
    printed, classes = shingles.components(own.select("_k", "_t", "text"), width)
    least = printed.groupBy("v").agg(F.min(F.struct("_k", "_t")).alias("row"))  # a row for each set, so many copies are no hot key
    kept = staged(least.join(classes, "v").groupBy("component").agg(F.min("row").alias("row")).select("row._k", "row._t"), "shingle-kept")
    found = own.join(kept, ["_k", "_t"], "left_semi")
    if not printed.groupBy("_k", "_t").count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["_k", "_t"])
    return found.drop("_k", "_t").select(*docs.columns)


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    found = near_duplicates(documents(spark, sf_dir), width=3, seeds=(42,), distance=3)
    # hex() of a long shows its unsigned bits
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("words")[0]), 16, "0")).alias("fingerprint"), "component_id")
