"""Packing documents into sequences of a fixed length: bounded-space online best fit.

Each task holds a fixed number of open windows. A document's ids are cut into whole windows, which are sequences at
once, and a rest, which goes to the open window that it leaves the least room in; if none has room, the fullest is
emitted and a new one opened. What is open at the end of a task is a leftover; leftovers of several tasks are packed
again in the same way, until one task remains.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_SLICE, documents, slices, staged, text_sizes
from .tokens import END_ID, tokenizer_path, word_tokenizer

LENGTH = 2048
OPEN_WINDOWS = 64
#: Tasks whose leftovers meet in one task of the next round.
MERGED_TASKS = 16

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"
_TYPES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())])


class Packer:
    """The open windows of one task. A window is a list of pieces (doc_id, start, doc_tokens, ids)."""

    def __init__(self, first_sequence: int, length: int, windows: int):
        self.next, self.length, self.limit = first_sequence, length, windows
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.pieces: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _emit(self, window: int, still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, doc_tokens, ids in self.pieces.pop(window):
            self.rows.append((doc_id, start, len(ids), doc_tokens, window, offset, ids.tobytes(), still_open))
            offset += len(ids)

    def _open(self) -> int:
        window, self.next = self.next, self.next + 1
        self.pieces[window] = []
        return window

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        while len(ids) >= self.length:
            window = self._open()
            self.pieces[window].append((doc_id, start, doc_tokens, ids[: self.length]))
            self._emit(window)
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return
        at = bisect.bisect_left(self.room, (len(ids), -1))
        if at < len(self.room):
            left, window = self.room.pop(at)
        else:
            if len(self.room) >= self.limit:
                self._emit(self.room.pop(0)[1])
            left, window = self.length, self._open()
        self.pieces[window].append((doc_id, start, doc_tokens, ids))
        if left == len(ids):
            self._emit(window)
        else:
            bisect.insort(self.room, (left - len(ids), window))

    def close(self, still_open: bool) -> None:
        for _, window in self.room:
            self._emit(window, still_open)
        self.room.clear()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_TYPES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _TYPES, strict=True)], schema=_TYPES)


def _first_sequence(pass_number: int) -> int:
    """Sequence numbers of a task: 7 bits of the pass, 24 of the partition, 32 of its own."""
    from pyspark import TaskContext

    return (pass_number << 56) + (TaskContext.get().partitionId() << 32)


def _pack_texts(path: str, length: int, windows: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = word_tokenizer(path), Packer(_first_sequence(0), length, windows)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(text_sizes(texts), ARROW_SLICE):
                ids, starts = tokenizer.encode_ended(texts[a:b], end_id)
                for k in range(b - a):
                    packer.add(doc_ids[a + k], 0, int(starts[k + 1] - starts[k]), ids[starts[k] : starts[k + 1]])
                yield packer.batch()
        packer.close(still_open=True)
        yield packer.batch()

    return run


def _pack_again(pass_number: int, length: int, windows: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_first_sequence(pass_number), length, windows)
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("doc_id", "start", "doc_tokens", "ids")]
            for doc_id, start, doc_tokens, ids in zip(*columns, strict=True):
                packer.add(doc_id, start, doc_tokens, np.frombuffer(ids, np.uint32))
            yield packer.batch()
        packer.close(still_open=not last)
        yield packer.batch()

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """docs with doc_id and text -> a row for each piece: doc_id, start (the document's ids before it), length,
    doc_tokens (the document's ids, with its end), sequence_id, offset (in the sequence, gapless from 0) and ids (binary,
    little-endian unsigned 32-bit). Each id lies in exactly one piece; sequences hold length ids at most.

    Null and empty texts are one piece, the end id. Repeated rows are packed as often as they occur; a null doc_id stays
    null. A text of any length is cut into whole windows. An empty table gives no piece. Other columns are ignored.
    """
    if length < 1 or windows < 1:
        raise ValueError("length and windows must be positive")
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = max(1, rows.rdd.getNumPartitions())
    packed = staged(rows.mapInArrow(_pack_texts(path, length, windows, end_id), PIECE), "packed")
    done, rest, pass_number = [packed.where("not open")], packed.where("open"), 0
    while True:
        pass_number += 1
        tasks = -(-tasks // MERGED_TASKS)
        rest = rest.repartition(tasks, "sequence_id")
        rest = rest.mapInArrow(_pack_again(pass_number, length, windows, tasks == 1), PIECE)
        if tasks == 1:
            return reduce(DataFrame.unionByName, [*done, rest]).drop("open")
        rest = staged(rest, "packed-again")
        done.append(rest.where("not open"))
        rest = rest.where("open")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
