"""What several operators of this subpackage share: reading, shared storage and words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, staged  # noqa: F401  for all operators

#: Stands for a null doc_id where rows have to be ordered or joined by it: such rows come last.
NO_ID = 2**63 - 1
#: Bytes of text that a task turns into Python words at once.
TEXT_SLICE = 4 << 20
#: Bytes of text whose words go through Arrow at once: in more text, more words are seen before.
ARROW_SLICE = 12 << 20
#: A per-process word table starts anew, or loses its rarer half, beyond so many words or so many bytes of words.
WORD_TABLE = 250_000
WORD_BYTES = 32 << 20
#: A longer word isn't kept when a table shrinks.
LONG_WORD = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """While a table is written, rows go to Python in batches of so many bytes at most; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def slices(sizes: list[int], limit: int = TEXT_SLICE) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that hold about limit bytes together; an element is never cut."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def text_sizes(column: pa.Array) -> list[int]:
    """Bytes of each text; null: 0."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of a column of texts: (the place of each word among the different ones, these, where each
    text's words start, with the end). Null: no words."""
    split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    whole = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at the ends of a text gives empty words
    if not whole.all():
        ends, flat = np.concatenate([[0], np.cumsum(whole)])[ends], flat.filter(pa.array(whole))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, ends


class WordHashes:
    """XXH64 of words as a numpy array. bytes.split() cuts at exactly [\\x20\\x09-\\x0D]+."""

    def __init__(self, seed: int = 0):
        self.seed, self.known, self.held = seed, {}, 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, seed = self.known, self.seed
        if len(known) > WORD_TABLE or self.held > WORD_BYTES:
            known.clear()
            self.held = 0
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, seed)
            self.held += len(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class LearnedIds:
    """What each known string stands for: a run of ids. Past its limits (strings, and characters of them) only short
    strings stay, and of these the ones that were used most often, up to half of each limit."""

    def __init__(self, dtype, limit: int = WORD_TABLE):
        self.limit, self.held = limit, 0
        self.place: dict = {}
        self.flat = np.empty(1 << 16, dtype)
        self.start = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _add(self, strings: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        used, first = int(self.start[-1]), len(self.uses)
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat) // 2, len(ids)), self.flat.dtype)])
        self.flat[used : used + len(ids)] = ids
        self.place.update(zip(strings, range(first, first + len(strings)), strict=True))
        self.start = np.concatenate([self.start, used + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(strings), np.int64)])
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.lengths = np.concatenate([self.lengths, lengths])
        self.held += int(lengths.sum())

    def runs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs one after another, where each starts, with the end)."""
        begin = self.start[places]
        sizes = self.start[places + 1] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)], ends

    def __call__(self, strings: list, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The runs of strings, or of strings[order]. learn gives (ids one after another, number of ids of each) for
        strings not known yet."""
        places = np.fromiter(map(self.place.get, strings, repeat(-1)), np.int64, len(strings))
        lacking = np.flatnonzero(places < 0)
        if len(lacking):
            own = [strings[i] for i in lacking.tolist()]
            new = list(dict.fromkeys(own))
            self._add(new, *learn(new))
            places[lacking] = np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))
        if order is not None:
            places = places[order]
        self.uses += np.bincount(places, minlength=len(self.uses))
        out = self.runs(places)
        if len(self.place) > self.limit or self.held > WORD_BYTES:
            self._shrink()
        return out

    def _shrink(self) -> None:
        kept = np.argsort(-self.uses, kind="stable")
        kept = kept[self.lengths[kept] <= LONG_WORD]
        kept = np.sort(kept[np.cumsum(self.lengths[kept]) <= WORD_BYTES // 2][: self.limit // 2])
        ids, ends = self.runs(kept)
        after = np.full(len(self.uses), -1)
        after[kept] = np.arange(len(kept))
        self.place = {x: a for x, a in zip(self.place, after[list(self.place.values())].tolist(), strict=True) if a >= 0}
        self.flat, self.start, self.uses, self.lengths = ids, ends, self.uses[kept] // 2, self.lengths[kept]
        self.held = int(self.lengths.sum())


_per_process: dict = {}


def give_back() -> None:
    """Returns freed memory to the machine: a worker lives on in the next stage, with what it once held still counted."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def per_process(group: str, key, make: Callable):
    """One object of a key for the life of a Python worker, or until another group of objects is asked for: what one
    operator remembers doesn't stay beside what the next one does."""
    if any(g != group for g, _ in _per_process):
        _per_process.clear()
        give_back()
    if (group, key) not in _per_process:
        _per_process[group, key] = make()
    return _per_process[group, key]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash modulo 2**64 of every run of width values, mixed at the end.

    Built by doubling, so that a width costs about 2 log2(width) passes over the array.
    """
    if len(values) < width:
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    block, span = values, 1  # block[i] hashes values[i : i + span]
    out, done = None, 0
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out, done = block, span
            else:
                n = len(block) - done
                out = out[:n] * np.uint64(pow(base, span, 2**64)) + block[done : done + n] if n > 0 else out[:0]
                done += span
        rest >>= 1
        if rest:
            n = len(block) - span
            block = block[:n] * np.uint64(pow(base, span, 2**64)) + block[span : span + n] if n > 0 else block[:0]
            span *= 2
    return mixed(out[: len(values) - width + 1])


def struct_array(**columns: pa.Array | np.ndarray) -> pa.Array:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def id_or_last(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))
