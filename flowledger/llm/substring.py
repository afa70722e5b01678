"""Exact removal of repeated passages: Rabin-Karp hashes of every window of a fixed number of words, counted in Spark.

A task hashes the windows of some documents at a time, keeps each hash once with its smallest document, and deals the
hashes out by their leading bits, packed as sorted byte planes. The partition that owns a hash finds the smallest
document over all tasks; every other document of the hash gets it as a hit. Each document then joins its hits, marks
the windows, and merges them into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, id_or_last, mixed, partitions, per_process, rolling, slices, text_bytes

#: Words in a window.
WINDOW = 13
#: Bytes of text whose windows a task holds at once.
HELD_TEXT = 12 << 20
#: Hits that an owner of hashes holds at once.
HELD_HITS = 1 << 20
#: Ranges of hashes for each shuffle partition, so that partitions get near the same number.
RANGES = 8


def packed(values: np.ndarray) -> bytes:
    """64-bit integers by byte planes, compressed: the leading bytes of sorted values cost little."""
    planes = np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


def ordered(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned integers of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def unordered(ids: np.ndarray) -> np.ndarray:
    return (ids ^ np.uint64(1 << 63)).view(np.int64)


def first_of_each(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with the smallest id of each; and the (hash, id) pairs of larger ids, each once."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    larger = ids > least
    larger[1:] &= (ids[1:] != ids[:-1]) | new[1:]
    return hashes[new], ids[new], hashes[larger], ids[larger]


def _window_rows(window: int, ranges: int):
    """Batches of (doc_id, text) -> rows (range, hashes, ids, hit_hashes, hit_ids)."""

    def rows_of(ids: list[int], texts: list[bytes]) -> pa.RecordBatch | None:
        hashes_of = per_process("words", 0, WordHashes)
        found, owners = [], []
        for a, b in slices([len(x) for x in texts]):
            words, starts = [], [0]
            for x in texts[a:b]:
                words += x.split()
                starts.append(len(words))
            hashes = hashes_of(words)
            del words
            windows = rolling(hashes, window)
            owner = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(starts))
            whole = owner[: len(windows)] == owner[window - 1 : window - 1 + len(windows)]
            found.append(windows[whole])
            owners.append(ordered(np.array(ids[a:b]))[owner[: len(windows)][whole]])
        hashes, doc_ids, hit_hashes, hit_ids = first_of_each(np.concatenate(found), np.concatenate(owners))
        if not len(hashes):
            return None
        # range k has the hashes from ceil(k * 2**64 / ranges)
        bounds = np.array([-(-k * 2**64 // ranges) for k in range(1, ranges)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])
        hit_at = np.concatenate([[0], np.searchsorted(hit_hashes, bounds), [len(hit_hashes)]])
        some = np.flatnonzero(np.diff(at))
        cut = lambda x, at: pa.array([packed(x[at[k] : at[k + 1]]) if at[k] < at[k + 1] else b"" for k in some], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), cut(hashes, at), cut(doc_ids, at), cut(hit_hashes, hit_at), cut(hit_ids, hit_at)], names=["range", "hashes", "ids", "hit_hashes", "hit_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held >= HELD_TEXT:
                    if (out := rows_of(ids, texts)) is not None:
                        yield out
                    ids, texts, held = [], [], 0
        if ids and (out := rows_of(ids, texts)) is not None:
            yield out

    return run


def _hit_rows(groups: int):
    """Rows sorted by range -> rows (group, ids, hits): of a group of documents, each (id, hash) whose hash also starts
    in a smaller document. Packed, so that a document doesn't cost a row for each task that owns one of its hashes."""

    def by_group(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        group = (mixed(ids) % np.uint64(groups)).astype(np.int32)
        order = np.lexsort((ids, group))
        hashes, ids, group = hashes[order], ids[order], group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, int)
        cut = lambda x: pa.array([packed(y) for y in np.split(x, starts[1:])] if len(x) else [], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(group[starts]), cut(ids), cut(hashes)], names=["group", "ids", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def close(rows: list[tuple]) -> None:
            hashes, ids, hits, hit_ids = ([unpacked(x) for x in column if x] for column in zip(*rows, strict=True))
            found.extend(zip(hits, hit_ids, strict=True))
            _, _, more, more_ids = first_of_each(np.concatenate(hashes), np.concatenate(ids))
            found.append((more, more_ids))

        at, rows = None, []
        for batch in batches:
            columns = [x.to_pylist() for x in batch.columns]
            for k, *row in zip(*columns, strict=True):
                if k != at and rows:
                    close(rows)
                    rows = []
                    if sum(len(x) for x, _ in found) >= HELD_HITS:
                        yield by_group(found)
                        found.clear()
                at = k
                rows.append(row)
        if rows:
            close(rows)
        if found:
            yield by_group(found)

    return run


def _document_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> (id, hits): one row for each document with hits."""

    def by_document(rows: list[tuple]) -> pa.RecordBatch:
        ids, hits = (np.concatenate([unpacked(x) for x in column]) for column in zip(*rows, strict=True))
        order = np.argsort(ids, kind="stable")
        ids, hits = ids[order], hits[order]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(unordered(ids[starts])), pa.array([x.tobytes() for x in np.split(hits, starts[1:])], pa.binary())], names=["id", "hits"])

    at, rows = None, []
    for batch in batches:
        for k, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if k != at and rows:
                yield by_document(rows)
                rows = []
            at = k
            rows.append(row)
    if rows:
        yield by_document(rows)


def removal_spans(words: list[bytes], hits: np.ndarray, hashes_of: WordHashes, window: int) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of words covered by windows whose hash is among the hits."""
    if not len(hits) or len(words) < window:
        return []
    marked = np.isin(rolling(hashes_of(words), window), hits)
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(marked)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _removal_column(window: int):
    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,spans:array<struct<start:bigint,end:bigint>>,kept:string>")
    def of(text: pa.Array, hits: pa.Array) -> pa.Array:
        hashes_of = per_process("words", 0, WordHashes)
        n_words, n_removed, spans, kept = [], [], [], []
        for x, own in zip(text_bytes(text), hits.to_pylist(), strict=True):
            words = x.split()
            cut = removal_spans(words, np.frombuffer(own or b"", np.uint64), hashes_of, window)
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in cut))
            spans.append([{"start": a, "end": b} for a, b in cut])
            for a, b in reversed(cut):
                del words[a:b]
            kept.append(b" ".join(words).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["n_words", "n_removed", "spans", "kept"])

    return of


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with doc_id and text -> docs with a column removal: a struct of n_words, n_removed, spans (maximal intervals
    [start, end) of removed words) and kept (the words that stay, joined by one space).

    A word [^\\x20\\x09-\\x0D]+ is removed if it lies in a window of so many words of its document that also starts in a
    document with a smaller doc_id. All windows are judged on the input. Windows are compared by 64-bit hashes.

    Null text: no words. Documents shorter than a window lose nothing. Rows with the same doc_id don't remove from each
    other. A null doc_id counts as larger than all others. All columns stay; one named removal is replaced.
    """
    n = partitions(docs.sparkSession)
    own = docs.withColumn("_row_id", id_or_last())
    windows = docs.select(id_or_last().alias("doc_id"), "text").mapInArrow(_window_rows(window, RANGES * n), "range int, hashes binary, ids binary, hit_hashes binary, hit_ids binary")
    hits = windows.repartition(n, "range").sortWithinPartitions("range").mapInArrow(_hit_rows(2 * n), "group int, ids binary, hits binary")
    hits = hits.repartition(n, "group").sortWithinPartitions("group").mapInArrow(_document_hits, "id long, hits binary")
    hits = hits.withColumnsRenamed({"id": "_row_id", "hits": "_row_hits"})
    found = own.join(hits, "_row_id", "left")
    return found.withColumn("removal", _removal_column(window)("text", "_row_hits")).drop("_row_id", "_row_hits")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "removal.n_words", "removal.n_removed", F.sha2(F.col("removal.kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT row_id, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
), keyed AS (
  SELECT row_id, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM windows
), firsts AS (
  SELECT k, min(doc_id) AS least FROM keyed GROUP BY k
), covered AS (
  SELECT DISTINCT row_id, unnest(range(i, i + 13)) AS j FROM keyed JOIN firsts USING (k) WHERE keyed.doc_id > firsts.least
), gone AS (
  SELECT row_id, list(j) AS js FROM covered GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(js, j)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (row_id)
"""
