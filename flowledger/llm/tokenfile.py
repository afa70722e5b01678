"""Binary token files: patched frame-of-reference blocks.

A file holds the ids of some documents, in blocks of 128. Of each block the minimum is taken off; what is left is packed
at the width that fits a chosen percentile of it; larger values are exceptions, whose high bits stand in a list with
their places. An index gives the byte at which each block starts, so that any run of ids is read without the rest.

Layout, little-endian: 4 bytes mark, u32 version, u64 documents n, u64 ids, u64 blocks b; then n u32 ids of each document;
then b + 1 u64 block starts (in bytes of the body); then the body: for each block u32 minimum, u8 width, u8 high width,
u8 exceptions, one zero byte, ceil(128 * width / 8) bytes of packed low bits, one byte for each exception's place, and
ceil(exceptions * high width / 8) bytes of packed high bits. Bits are packed lowest first; the last block is filled up
with its minimum.

Files are binary values of a Parquet table, one row for each (the key is the smallest doc_id in it), since Spark can
write and read those in any store.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ARROW_SLICE, documents, id_or_last, partitions, shared_dir, slices, text_sizes
from .tokens import END_ID, tokenizer_path, word_tokenizer

MARK, VERSION, BLOCK = b"PFOR", 1, 128
#: Share of a block's values that must fit the packed width.
PERCENTILE = 90
#: Ids after which a file is closed.
FILE_IDS = 1 << 20
#: Most files whose places in the whole are broadcast.
BROADCAST_FILES = 500_000
_HEAD = struct.Struct("<4sIQQQ")


#: Blocks that are packed at once, so that their single bits stay few megabytes.
PACKED = 4096
_BITS = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values to rows of bytes, width bits each, lowest first. Eight values of up to 16 bits fill two 64-bit
    integers, of whose bytes the first width count."""
    n, count = values.shape
    if width > 16 or count % 8:
        kind = "<u2" if width <= 16 else "<u4"
        bits = np.unpackbits(values.astype(kind).view(np.uint8).reshape(n, count, -1), axis=2, bitorder="little")[:, :, :width]
        return np.packbits(bits.reshape(n, -1), axis=1, bitorder="little")
    eights = values.reshape(-1, 8).astype(np.uint64)
    halves = np.zeros((len(eights), 2), "<u8")
    for i in range(8):
        at, value = i * width, eights[:, i]
        if at < 64:
            halves[:, 0] |= value << np.uint64(at)
        if at >= 64:
            halves[:, 1] |= value << np.uint64(at - 64)
        elif at + width > 64:
            halves[:, 1] |= value >> np.uint64(64 - at)
    return halves.view(np.uint8).reshape(-1, 16)[:, :width].reshape(n, -1)


def _unpack_bits(rows: np.ndarray, width: int, count: int) -> np.ndarray:
    if width > 16 or count % 8:
        kind, size = ("<u2", 16) if width <= 16 else ("<u4", 32)
        bits = np.unpackbits(rows, axis=1, bitorder="little")[:, : count * width].reshape(len(rows), count, width)
        padded = np.zeros((len(rows), count, size), np.uint8)
        padded[:, :, :width] = bits
        return np.packbits(padded, axis=2, bitorder="little").view(kind)[:, :, 0].astype(np.uint32)
    halves = np.zeros((len(rows) * count // 8, 16), np.uint8)
    halves[:, :width] = rows.reshape(-1, width)
    low, high = halves.view("<u8").T
    out, mask = np.empty((len(low), 8), np.uint32), np.uint64((1 << width) - 1)
    for i in range(8):
        at = i * width
        value = low >> np.uint64(at) if at < 64 else high >> np.uint64(at - 64)
        if at < 64 < at + width:
            value = value | high << np.uint64(64 - at)
        out[:, i] = value & mask
    return out.reshape(len(rows), count)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; 0 for 0."""
    high = values >> np.uint32(16)
    return np.where(high > 0, 16 + _BITS[high], _BITS[values & np.uint32(0xFFFF)])


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(block starts with the end, body)."""
    step, starts, bodies = PACKED * BLOCK, [np.zeros(1, np.int64)], []
    for a in range(0, len(ids), step):
        own, body = _encode_some(ids[a : a + step], percentile)
        starts.append(own[1:] + starts[-1][-1])
        bodies.append(body)
    return np.concatenate(starts).astype(np.uint64), b"".join(bodies)


def _encode_some(ids: np.ndarray, percentile: int) -> tuple[np.ndarray, bytes]:
    """Blocks of one width are packed together."""
    n = -(-len(ids) // BLOCK)
    grid = np.empty((n, BLOCK), np.uint32)
    grid.ravel()[: len(ids)] = ids
    tail = len(ids) - (n - 1) * BLOCK
    grid[-1, tail:] = grid[-1, :tail].min()
    low = grid.min(axis=1)
    grid -= low[:, None]
    bits = _widths(grid)
    place = -(-BLOCK * percentile // 100) - 1
    width = np.partition(bits, place, axis=1)[:, place].astype(np.int64)
    high = np.maximum(bits.max(axis=1).astype(np.int64) - width, 0)
    over = grid >> width[:, None].astype(np.uint32)
    over[width >= 32] = 0
    exceptions = (over > 0).sum(axis=1)
    packed = -(-BLOCK * width // 8)
    sizes = 8 + packed + exceptions + -(-exceptions * high // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(starts[-1], np.uint8)
    head = np.zeros((n, 8), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5], head[:, 6] = width, high, exceptions
    body[starts[:-1, None] + np.arange(8)] = head
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            mask = np.uint32(0xFFFFFFFF if w >= 32 else (1 << w) - 1)
            body[starts[rows, None] + 8 + np.arange(packed[rows[0]])] = _pack_bits(grid[rows] & mask, int(w))
    shapes = exceptions * 64 + high
    for shape in np.unique(shapes[exceptions > 0]):
        rows = np.flatnonzero(shapes == shape)
        k, w = int(shape) // 64, int(shape) % 64
        place = np.nonzero(over[rows])[1].reshape(len(rows), k)
        at = starts[rows, None] + 8 + packed[rows, None]
        body[at + np.arange(k)] = place
        values = _pack_bits(np.take_along_axis(over[rows], place, axis=1), w)
        body[at + k + np.arange(values.shape[1])] = values
    return starts, body.tobytes()


def decode_blocks(starts: np.ndarray, body: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first up to last. Only these blocks' bytes are touched."""
    starts = starts[first : None if last is None else last + 1].astype(np.int64)
    n = len(starts) - 1
    if n <= 0:
        return np.empty(0, np.uint32)
    head = body[starts[:-1, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, high, exceptions = (head[:, i].astype(np.int64) for i in (4, 5, 6))
    grid = np.zeros((n, BLOCK), np.uint32)
    packed = -(-BLOCK * width // 8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        grid[rows] = _unpack_bits(body[starts[rows, None] + 8 + np.arange(packed[rows[0]])], int(w), BLOCK)
    shapes = exceptions * 64 + high
    for shape in np.unique(shapes[exceptions > 0]):
        rows = np.flatnonzero(shapes == shape)
        k, w = int(shape) // 64, int(shape) % 64
        at = starts[rows, None] + 8 + packed[rows, None]
        place = body[at + np.arange(k)].astype(np.int64)
        values = _unpack_bits(body[at + k + np.arange(-(-k * w // 8))], w, k)
        grid[rows[:, None], place] |= values << width[rows, None].astype(np.uint32)
    return (grid + low[:, None]).ravel()


def encode_file(ids: np.ndarray, sizes: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A file of documents of the given numbers of ids, which lie in ids one after another."""
    starts, body = encode_blocks(ids, percentile)
    return b"".join([_HEAD.pack(MARK, VERSION, len(sizes), len(ids), len(starts) - 1), sizes.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), body])


class TokenFile:
    """Reads a file's documents, or any run of its ids, from its bytes."""

    def __init__(self, data: bytes):
        mark, version, n, self.n_ids, blocks = _HEAD.unpack_from(data)
        if mark != MARK or version != VERSION:
            raise ValueError("not a token file of this version")
        self.sizes = np.frombuffer(data, "<u4", n, _HEAD.size)
        self.starts = np.frombuffer(data, "<u8", blocks + 1, _HEAD.size + 4 * n)
        self.body = np.frombuffer(data, np.uint8, offset=_HEAD.size + 4 * n + 8 * (blocks + 1))

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        parts = [decode_blocks(self.starts, self.body, a, min(a + PACKED, last)) for a in range(first, last, PACKED)]
        return np.concatenate(parts)[start - first * BLOCK : end - first * BLOCK]


FILE = "part long, number long, first_id long, ids_in_file long, doc_ids binary, file binary"


def _write_files(path: str, end_id: int, percentile: int, file_ids: int):
    """Texts in order -> rows of files. part is the task, number counts its files; doc_ids are the documents' ids (int64,
    then a bit for each, 0 for null), which the file itself doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        tokenizer = word_tokenizer(path)
        held, sizes, doc_ids, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            own = pa.concat_arrays(doc_ids)
            values, valid = own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False)
            data = encode_file(np.concatenate(held), np.concatenate(sizes), percentile)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, number, own[0].as_py(), n)] + [pa.array([values.tobytes() + np.packbits(valid).tobytes()], pa.binary()), pa.array([data], pa.binary())], names=[x.split()[0] for x in FILE.split(", ")])

        for batch in batches:
            own, texts = batch.column(0), batch.column(1)
            for a, b in slices(text_sizes(texts), 2 * ARROW_SLICE):
                ids, starts = tokenizer.encode_ended(texts[a:b], end_id)
                held.append(ids)
                sizes.append(np.diff(starts))
                doc_ids.append(own[a:b])
                n += len(ids)
                if n >= file_ids:
                    yield row()
                    held, sizes, doc_ids, n, number = [], [], [], 0, number + 1
        if doc_ids:
            yield row()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, percentile: int = PERCENTILE, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of all texts, each with end_id after it, in ascending doc_id order, to a new table of files.

    Null text: the end id alone. Rows of one doc_id lie side by side, ordered by their text; a null doc_id comes last.
    An empty table gives an empty table of files. Other columns are ignored.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", id_or_last().alias("at"))
    # ranges are by doc_id and text, so that many rows of one doc_id still go to many tasks
    rows = rows.repartitionByRange(n, "at", F.xxhash64("text")).sortWithinPartitions("at", F.xxhash64("text"), "text").select("doc_id", "text")
    rows.mapInArrow(_write_files(path or tokenizer_path(), end_id, percentile, file_ids), FILE).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit) of each
    document of a folder that write_token_files made. Files' places in the whole are sums over the table of files."""
    files = spark.read.schema(FILE).parquet(folder)
    parts = files.groupBy("part").agg(F.sum("ids_in_file").alias("part_ids"))
    before = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    within = files.select("part", "number", (F.sum("ids_in_file").over(Window.partitionBy("part").orderBy("number")) - F.col("ids_in_file")).alias("file_start"))
    starts = within.join(before, "part").select("part", "number", (F.col("part_start") + F.col("file_start")).alias("start"))
    if files.select("part").count() <= BROADCAST_FILES:  # three integers for each file; beyond that, Spark shuffles the files
        starts = F.broadcast(starts)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own, data in zip(*(batch.column(x).to_pylist() for x in ("start", "doc_ids", "file")), strict=True):
                file = TokenFile(data)
                doc_ids = np.frombuffer(own, np.int64, len(file.sizes))
                null = np.unpackbits(np.frombuffer(own, np.uint8, offset=doc_ids.nbytes))[: len(doc_ids)] == 0
                ends = np.concatenate([[0], np.cumsum(file.sizes, dtype=np.int64)])
                for a, b in slices(file.sizes.tolist(), 1 << 19):
                    ids = file.ids(int(ends[a]), int(ends[b])).astype("<u4")
                    cuts = ends[a : b + 1] - ends[a]
                    values = pa.array([ids[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64(), mask=null[a:b]), pa.array(at + ends[a:b]), pa.array(file.sizes[a:b].astype(np.int64)), values], names=["doc_id", "start", "n_tokens", "ids"])

    return files.join(starts, ["part", "number"]).select("start", "doc_ids", "file").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
