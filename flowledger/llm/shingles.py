"""Near copies by SimHash and by the exact Jaccard similarity of their sets of word shingles.

Documents meet in two ways. SimHash fingerprints that differ in few bits meet by covering masks, see simhash.links; at a
similarity of 0.8 two fingerprints differ in a seventh of their bits on average, so this alone would miss links. Therefore
sets also meet on shingles: in one order of all shingles, two sets of a similarity of at least PER_TEN tenths have a
shingle in common among the first n - ceil(n * PER_TEN / 10) + 1 of each, so no pair is missed. Each pair that meets is
held against the sizes of both sets, the places of the shingle in both, bitmaps whose differing bits are never more than
the differing shingles (a short one while meeting, then one that grows with the set), and at last the whole sets. Shingles
are compared by 64-bit hashes.

Pairs of one group are not all written: first each set meets the middle of its group, then the nearest set of another
component, and only what these rounds leave apart is compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, partitions, per_process, rolling, slices, staged, struct_array, text_bytes
from .graph import connected_components
from .prints import majority_bits

#: Similarity 0.8 as integers: common * 9 >= 4 * (n + m) is common / (n + m - common) >= 0.8.
PER_TEN = 8
#: Length of the short bitmap, in 64-bit words.
BITMAP_WORDS = 8
#: Shingles found so often in one of SAMPLE documents come last in the order, FREQUENT of them at most. The order of
#: shingles has no influence on what is found, only on how many unlike documents meet.
SAMPLE, OFTEN, FREQUENT = 32, 5, 50_000
TILE = 1024


def shingle_sets(texts: list[bytes], width: int, words: WordHashes) -> list[np.ndarray]:
    """The different hashes of each text's shingles, ascending. A-Z are lower-cased; a text of fewer words is one shingle."""
    out = []
    for text in texts:
        own = words(text.lower().split())
        out.append(np.unique(rolling(own, min(width, len(own)))) if len(own) else own)
    return out


def _sets_of(column: pa.Array, width: int):
    words = per_process("shingles", "words", WordHashes)
    texts = text_bytes(column)
    for a, b in slices([len(x) for x in texts], 1 << 20):
        yield from shingle_sets(texts[a:b], width, words)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))


def set_column(width: int):
    """array<long>: all shingles of the column text."""

    @F.arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        return _lists(list(_sets_of(column, width)))

    return of(F.col("text"))


def bitmap(shingles: np.ndarray, n_words: int) -> np.ndarray:
    """Each shingle flips one bit. With a power of two of words, the halves of a bitmap XORed are the one of half the length."""
    odd = np.bincount((shingles % np.uint64(64 * n_words)).astype(np.int64), minlength=64 * n_words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def long_bitmap_column(width: int):
    """array<long>: a bitmap of two bits at least for each shingle of the column text."""

    @F.arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        return _lists([bitmap(x, 1 << max(0, (len(x) - 1) // 32).bit_length()) for x in _sets_of(column, width)])

    return of(F.col("text"))


def print_column(width: int, frequent: np.ndarray):
    """A struct: v (a hash of the set), n (its size), print (its SimHash), first (the shingles to meet on, in order), bits
    (the bitmap)."""

    @F.arrow_udf("struct<v:bigint,n:bigint,print:bigint,first:array<bigint>,bits:array<bigint>>")
    def of(column: pa.Array) -> pa.Array:
        v, n, prints, first, bits = [], [], [], [], []
        for own in _sets_of(column, width):
            prints.append(majority_bits(own, np.array([0, len(own)]))[0])
            v.append(xxhash.xxh64_intdigest(own.tobytes()))
            n.append(len(own))
            bits.append(bitmap(own, BITMAP_WORDS))
            late = frequent[np.searchsorted(frequent[:-1], own)] == own if len(frequent) else np.zeros(len(own), bool)
            first.append(np.concatenate([own[~late], own[late]])[: len(own) - -(-len(own) * PER_TEN // 10) + 1])
        return struct_array(v=np.array(v, np.uint64).view(np.int64), n=np.array(n, np.int64), print=np.array(prints, np.uint64).view(np.int64), first=_lists(first), bits=_lists(bits))

    return of(F.col("text"))


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    some = docs.where(F.pmod(F.xxhash64("_k", "_t"), F.lit(SAMPLE)) == 0).select(F.explode(set_column(width)).alias("s"))
    counts = some.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(np.array([r["s"] for r in counts.orderBy(F.desc("n"), "s").limit(FREQUENT).collect()], np.int64).view(np.uint64))


#: What a row of a group carries, beside the shingle s: set, component, size of the set, place of s in it.
_FIELDS = ("s", "v", "c", "n", "i")


class _Group:
    """Rows of some whole groups (of one shingle s each), in order of s."""

    def __init__(self, s: np.ndarray, v: np.ndarray, c: np.ndarray, n: np.ndarray, i: np.ndarray, bits: np.ndarray):
        self.s, self.v, self.c, self.n, self.i, self.bits = s, v, c, n, i, bits
        self.starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        self.sizes = np.diff(np.append(self.starts, len(s)))

    def mixed(self) -> _Group:
        """The groups that lie in more than one component."""
        some = np.minimum.reduceat(self.c, self.starts) != np.maximum.reduceat(self.c, self.starts)
        keep = np.repeat(some, self.sizes)
        return _Group(*(x[keep] for x in (self.s, self.v, self.c, self.n, self.i, self.bits)))

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs of rows may be near and aren't in one component, their differing bits). No near pair is turned down:
        of two sets with so many common shingles, all of these come at or after the first common one in both."""
        a, b = self.n[x], self.n[y]
        least = -(-(a + b) * PER_TEN // (10 + PER_TEN))
        some = np.flatnonzero((self.c[x] != self.c[y]) & (self.i[x] <= a - least) & (self.i[y] <= b - least))
        apart = np.bitwise_count(self.bits[x[some]] ^ self.bits[y[some]]).sum(axis=1, dtype=np.int64)
        fits = apart * (10 + PER_TEN) <= (a[some] + b[some]) * (10 - PER_TEN)
        return some[fits], apart[fits]

    def middles(self) -> np.ndarray:
        """For each group the row nearest to the majority of its bitmaps, the least v among equals."""
        owner, counts = np.repeat(np.arange(len(self.starts)), self.sizes), np.zeros((len(self.starts), 64 * BITMAP_WORDS), np.int32)
        for a in range(0, len(self.v), 16 * TILE):
            own = owner[a : a + 16 * TILE]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts[own[first]] += np.add.reduceat(np.unpackbits(self.bits[a : a + 16 * TILE].view(np.uint8), axis=1), first, axis=0, dtype=np.int32)
        middle = np.packbits(2 * counts > self.sizes[:, None], axis=1).view(np.uint64)
        apart = np.bitwise_count(self.bits ^ middle[owner]).sum(axis=1, dtype=np.int64)
        return np.lexsort((self.v, apart, owner))[self.starts]

    def tiles(self):
        """All pairs of rows of each group, a bounded number at a time."""
        n = len(self.v)
        ends, small = np.repeat(self.starts + self.sizes, self.sizes), np.repeat(self.sizes <= 8, self.sizes)
        for lag in range(1, min(8, n)):  # small groups at once: each row against its next few
            rows = np.arange(n - lag)
            rows = rows[(rows + lag < ends[: n - lag]) & small[: n - lag]]
            yield rows, rows + lag
        for start, size in zip(self.starts[self.sizes > 8].tolist(), self.sizes[self.sizes > 8].tolist(), strict=True):
            for i in range(start, start + size, TILE):
                for j in range(i, start + size, TILE):
                    x, y = np.meshgrid(np.arange(i, min(i + TILE, start + size)), np.arange(j, min(j + TILE, start + size)), indexing="ij")
                    yield x.ravel(), y.ravel()


def _middle_pairs(g: _Group):
    hub = np.repeat(g.middles(), g.sizes)
    rows = np.arange(len(g.v))
    some, _ = g.near(hub, rows)
    yield hub[some], rows[some]


def _nearest_pairs(g: _Group):
    """Each row with the row of another component that differs in the fewest bits, the least v among equals."""
    best, other = np.full(len(g.v), np.iinfo(np.int64).max), np.full(len(g.v), -1)
    for x, y in g.tiles():
        some, apart = g.near(x, y)
        for one, two in ((x[some], y[some]), (y[some], x[some])):
            order = np.lexsort((g.v[two], apart, one))
            first = order[np.flatnonzero(np.concatenate([[True], one[order][1:] != one[order][:-1]]))] if len(order) else order
            row, found, far = one[first], two[first], apart[first]
            better = (far < best[row]) | ((far == best[row]) & (g.v[found] < g.v[other[row]]))
            best[row[better]], other[row[better]] = far[better], found[better]
    rows = np.flatnonzero(other >= 0)
    yield rows, other[rows]


def _all_pairs(g: _Group):
    for x, y in g.tiles():
        some, _ = g.near(x, y)
        yield x[some], y[some]


def _pairs(choose):
    """Sorted by shingle s: the pairs that choose finds in each group, each once in a batch."""

    def of(*columns: np.ndarray) -> pa.RecordBatch:
        group = _Group(*columns)
        found, held = [np.empty((2, 0), np.int64)], 0
        if len(group.v) and len((group := group.mixed()).v):
            for x, y in choose(group):
                a, b = group.v[x], group.v[y]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                held += len(a)
                if held > 1 << 20:
                    found, held = [np.unique(np.concatenate(found, axis=1), axis=1)], 0
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(x).to_numpy(zero_copy_only=False) for x in _FIELDS]
            own.append(batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITMAP_WORDS))
            own = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            cut = int(np.searchsorted(own[0], own[0][-1]))
            if cut:  # the last group may go on in the next batch
                yield of(*(x[:cut] for x in own))
            held = [x[cut:] for x in own]
        if held is not None:
            yield of(*held)

    return run


def _bits_apart(x, y):
    """Differing bits of two bitmaps; the longer one is folded. Sizes of sets that may be near differ by a factor below 2,
    so lengths differ by one fold at most."""
    half = lambda z: F.zip_with(F.slice(z, 1, (F.size(z) / 2).cast("int")), F.slice(z, (F.size(z) / 2 + 1).cast("int"), (F.size(z) / 2).cast("int")), lambda a, b: a.bitwiseXOR(b))
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, k: t + k)


def _with_both(pairs: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    for v, end in (("a", "x"), ("b", "y")):
        pairs = pairs.join(table.select(F.col("v").alias(v), *(F.col(c).alias(c + end) for c in names)), v)
    return pairs


def _near(pairs: DataFrame, bitmaps: DataFrame, full) -> DataFrame:
    """The pairs (a, b) whose whole sets are near. full: a table of (v, all) for a table of v."""
    apart = _bits_apart(F.col("bitsx"), F.col("bitsy")) * (10 + PER_TEN) <= (F.col("nx") + F.col("ny")) * (10 - PER_TEN)
    some = staged(_with_both(pairs, bitmaps, "n", "bits").where(apart).select("a", "b"), "shingle-likely")
    sets = full(some.select(F.col("a").alias("v")).union(some.select("b")).distinct())
    common = F.size(F.array_intersect("allx", "ally"))
    return _with_both(some, sets, "all").where(common * (10 + PER_TEN) >= PER_TEN * (F.size("allx") + F.size("ally"))).select("a", "b")


def _fingerprint_pairs(sets: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are linked by covering masks, the least set standing for its fingerprint,
    and of each set with the least one of its own fingerprint."""
    from .simhash import links

    least = staged(sets.groupBy("print").agg(F.min("v").alias("least"), F.count("*").alias("m")), "shingle-fingerprints")
    linked = links(least.select(F.col("print").alias("id"), F.col("print").alias("w0")), 1, distance, distance)
    for x in ("a", "b"):
        linked = linked.join(least.select(F.col("print").alias(x), F.col("least").alias(f"least_{x}")), x)
    equal = sets.join(least.where("m > 1"), "print").where("v <> least")
    both = linked.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")).union(equal.select("v", "least"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(docs: DataFrame, width: int, distance: int = 3) -> tuple[DataFrame, DataFrame]:
    """docs: _k, _t, text. Returns (_k, _t, v) of all rows, v standing for a set of shingles, and (v, component) of every
    v: what can be reached over links of a similarity of 0.8 or more. distance: bits in which fingerprints that meet may
    differ. Null text: the empty set. An empty table gives empty ones."""
    spark = docs.sparkSession
    printed = staged(docs.select("_k", "_t", print_column(width, frequent_shingles(docs, width)).alias("p")).select("_k", "_t", "p.*"), "shingle-prints")
    sets = staged(printed.groupBy("v").agg(F.first(F.struct("_k", "_t", "n", "print", "first", "bits")).alias("r")).select("v", "r.*"), "shingle-sets")
    meeting = sets.select("v", F.posexplode("first").alias("i", "s")).withColumn("m", F.count("*").over(Window.partitionBy("s"))).where("m > 1")
    meeting = staged(meeting.select("s", "v", "i"), "shingle-meetings")

    def texts(of: DataFrame) -> DataFrame:
        """One text of each v."""
        return docs.join(sets.join(of, "v", "left_semi").select("v", "n", "_k", "_t"), ["_k", "_t"]).dropDuplicates(["v"])

    def full(of: DataFrame) -> DataFrame:
        return staged(texts(of).select("v", set_column(width).alias("all")), "shingle-full")

    bitmaps = staged(texts(meeting.select("v").distinct()).select("v", "n", long_bitmap_column(width).alias("bits")), "shingle-bitmaps")
    rows = meeting.join(sets.select("v", "n", "bits"), "v")

    def pairs(reached: DataFrame | None, choose) -> DataFrame:
        """Pairs of sets that are not in one component yet."""
        known = rows.withColumn("c", F.col("v"))
        if reached is not None:
            known = rows.join(reached.select(F.col("vertex").alias("v"), "component"), "v", "left").withColumn("c", F.coalesce("component", "v"))
        dealt = known.repartition(partitions(spark), "s").sortWithinPartitions("s").select(*_FIELDS, "bits")
        return dealt.mapInArrow(_pairs(choose), "a long, b long").distinct()

    tried = edges = reached = None
    for choose in (_middle_pairs, _nearest_pairs, _all_pairs):
        found = pairs(reached, choose)
        if tried is None:
            found = found.union(_fingerprint_pairs(sets, distance)).distinct()
        found = staged(found, "shingle-pairs")
        new = found if tried is None else found.join(tried, ["a", "b"], "left_anti")
        near = staged(_near(new, bitmaps, full), "shingle-edges")
        tried = found if tried is None else tried.union(found)
        if reached is None or not near.isEmpty():
            edges = near if edges is None else edges.union(near)
            reached = staged(connected_components(edges), "shingle-components")
    classes = sets.select("v").join(reached.select(F.col("vertex").alias("v"), "component"), "v", "left").select("v", F.coalesce("component", "v").alias("component"))
    return printed.select("_k", "_t", "v"), classes
