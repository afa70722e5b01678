"""SentencePiece encoding and decoding by suffix-array matching.

Text is cut where no piece can reach over: before each run of the space mark, and around characters of no piece. The
different cuts of a batch that are not known yet are laid one after another and indexed by a suffix array; a binary
search for every piece gives the range of suffixes that start with it, and so all its occurrences. These edges (position,
length, piece) are put in order by position. Then the cuts are relaxed: starting from characters, the neighbours whose
joint edge has the best score are joined, leftmost first among equals, until no edge joins two neighbours. That is the
order in which a BPE model of SentencePiece merges, so the ids are those of the library.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, LearnedIds, documents, per_process, slices, text_bytes

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NONE = np.int32(-1)
LAST = np.int32(2**31 - 1)
#: Characters of new cuts that are indexed together.
INDEXED = 1 << 20
#: Cuts of more characters are relaxed one by one.
LONG = 64
#: Bytes of text that a task cuts at once.
SLICE = 6 << 20


def model_path(name: str = DEFAULT_MODEL) -> str:
    return public_tokenizers.path(name)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes' first depth characters, by prefix doubling; equal ones by position."""
    rank, span = codes.astype(np.int64) + 1, 1

    def joined(step: int, base: int) -> np.ndarray:
        behind = np.zeros_like(rank)
        behind[: -step or None] = rank[step:] if step < len(rank) else 0
        return rank * base + behind

    if depth > 3:  # three characters fit one integer
        behind = np.zeros((2, len(rank)), np.int64)
        behind[0, :-1], behind[1, :-2] = rank[1:], rank[2:]
        rank, span = (rank << 42) + (behind[0] << 21) + behind[1], 3
    while span < depth:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
        step = min(span, depth - span)
        rank = joined(step, len(rank) + 2)
        span += step
    return np.argsort(rank, kind="stable")


def piece_ranges(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (a row of codes, sizes of them valid) the range of order whose suffixes start with it; all pieces
    are searched at once."""
    width = pieces.shape[1]
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    inside = np.arange(width) < sizes[:, None]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            seen = padded[order[middle][:, None] + np.arange(width)]
            apart = (seen != pieces[open_]) & inside[open_]
            first = apart.argmax(axis=1)
            each = np.arange(len(open_))
            differs = apart[each, first]
            less = np.where(differs, seen[each, first] < pieces[open_, first], after)
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        return low

    return bound(False), bound(True)


class PieceModel:
    """encode() and decode() give what SentencePiece gives for a BPE model with byte fallback and no normalization."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        special = [own.is_control(i) or own.is_unknown(i) or own.is_byte(i) for i in range(len(names))]
        self.byte_ids = np.array([own.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        normal = [i for i, s in enumerate(special) if not s]
        scores = np.array([own.get_score(i) for i in range(len(names))])
        self.piece_ids = np.array(normal, np.int32)
        self.sizes = np.array([len(names[i]) for i in normal])
        self.width = int(self.sizes.max())
        self.pieces = np.zeros((len(normal), self.width), np.uint32)
        for row, i in enumerate(normal):
            self.pieces[row, : len(names[i])] = [ord(c) for c in names[i]]
        # equal scores have equal ranks; one more for no edge
        self.rank = np.append(np.unique(-scores, return_inverse=True)[1].astype(np.int32), LAST)
        inside = [c for i in normal for c in names[i][1:] if c == SPACE and names[i].strip(SPACE)]
        if inside:
            raise ValueError("a piece holds a space mark after another character")
        letters = {c for i in normal for c in names[i]}
        self.lone = "".join(c for c in map(chr, range(1, 33)) if c not in letters)
        self.cuts = re.compile(f"{SPACE}*[^{SPACE}{re.escape(self.lone)}]+|{SPACE}+|[{re.escape(self.lone)}]" if self.lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        text_of = [b"" if own.is_control(i) else " ⁇ ".encode() if own.is_unknown(i) else b"" if own.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(len(names))]
        for b, i in enumerate(self.byte_ids):
            text_of[i] = bytes([b])
        self.text_of = text_of
        self.known = LearnedIds(np.int32, 2 * WORD_TABLE)

    # ------------------------------------------------------------ new cuts

    def edges(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(where each cut starts, table): table[position, length - 1] is the piece there, NONE without."""
        codes = np.frombuffer("\0".join(cuts).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in cuts])])
        order = suffix_array(codes, self.width)
        present = np.zeros(0x110000, bool)
        present[codes] = True
        possible = np.flatnonzero((present[self.pieces] | (self.pieces == 0)).all(axis=1))
        low, high = piece_ranges(codes, order, self.pieces[possible], self.sizes[possible])
        found = high - low
        index = np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())
        table = np.full((len(codes), self.width), NONE)  # a slot for each position and length: a counting sort of the edges
        table[order[index], np.repeat(self.sizes[possible] - 1, found)] = np.repeat(self.piece_ids[possible], found)
        return starts, table

    def _relax_rows(self, starts: np.ndarray, size: int, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Cuts of at most size characters, all at once -> next[row, i]: where the symbol that starts at i ends (0: none)."""
        n = len(starts)
        flat, width = table.ravel(), self.width
        at = np.arange(size + 1)
        following = np.where(at < lengths[:, None], at + 1, 0)
        before = np.where((at > 0) & (at <= lengths[:, None]), at - 1, -1)
        score = np.full((n, size + 1), LAST)

        def pair(rows: np.ndarray, i: np.ndarray) -> None:
            """Ranks of joining the symbol at i with the one after it."""
            middle = following[rows, i]
            end = np.where(middle < lengths[rows], following[rows, middle], 0)
            long = end - i
            fits = (end > 0) & (long <= width)
            slot = np.where(fits, (starts[rows] + i) * width + long - 1, 0)
            score[rows, i] = np.where(fits, self.rank[np.where(fits, flat[slot], NONE)], LAST)

        rows, i = np.nonzero(at[None, :] < lengths[:, None] - 1)
        pair(rows, i)
        active = np.arange(n)
        while len(active):
            best = score[active].argmin(axis=1)
            some = score[active, best] < LAST
            active, best = active[some], best[some]
            middle = following[active, best]
            end = following[active, middle]
            following[active, best] = end
            following[active, middle] = 0
            score[active, middle] = LAST
            before[active, end] = best
            pair(active, best)
            left = before[active, best]
            has = left >= 0
            pair(active[has], left[has])
        return following[:, :size]

    def _relax_long(self, start: int, length: int, table: np.ndarray) -> np.ndarray:
        following, before = list(range(1, length + 1)), list(range(-1, length))
        heap: list[tuple[int, int, int, int]] = []

        def pair(i: int) -> None:
            middle = following[i]
            if middle < length and (end := following[middle]) - i <= self.width and (piece := table[start + i, end - i - 1]) != NONE:
                heapq.heappush(heap, (int(self.rank[piece]), i, middle, end))

        for i in range(length - 1):
            pair(i)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if following[i] != middle or following[middle] != end:
                continue
            following[i], following[middle] = end, 0
            if end < length:
                before[end] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        return np.array(following)

    def _learn(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._encode_cuts(cuts[a:b]) for a, b in slices([len(x) for x in cuts], INDEXED)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids, sizes

    def _encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        starts, table = self.edges(cuts)
        lengths = np.diff(starts) - 1
        ends = np.zeros(len(table), np.int64)  # by position: length of the symbol that starts there
        size = 4
        done = 0
        while done < LONG:
            rows = np.flatnonzero((lengths > done) & (lengths <= size))
            for a in range(0, len(rows), 65536):
                own = rows[a : a + 65536]
                following = self._relax_rows(starts[own], size, lengths[own], table)
                row, i = np.nonzero(following)
                ends[starts[own][row] + i] = following[row, i] - i
            done, size = size, size * 2
        for k in np.flatnonzero(lengths > LONG):
            following = self._relax_long(int(starts[k]), int(lengths[k]), table)
            i = np.flatnonzero(following)
            ends[starts[k] + i] = following[i] - i
        at = np.flatnonzero(ends)
        ids = table[at, ends[at] - 1]
        owner = np.searchsorted(starts, at, side="right") - 1
        sizes = np.ones(len(at), np.int64)
        unknown = np.flatnonzero(ids == NONE)
        if len(unknown):  # single characters of no piece: their bytes
            codes = [cuts[owner[u]][at[u] - starts[owner[u]]].encode("utf-8") for u in unknown]
            sizes[unknown] = [len(x) for x in codes]
            place = np.cumsum(sizes) - sizes
            out = np.repeat(ids, sizes)
            for u, data in zip(unknown, codes, strict=True):
                out[place[u] : place[u] + len(data)] = self.byte_ids[list(data)]
            ids = out
        per_cut = np.bincount(owner, sizes, len(cuts)).astype(np.int64)
        return ids, per_cut

    # ------------------------------------------------------------ whole texts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids start, with the end)."""
        cuts, starts = [], [0]
        for text in texts:
            if text:
                cuts += self.cuts.findall(SPACE + text.decode().replace(" ", SPACE))
            starts.append(len(cuts))
        ids, ends = self.known(cuts, self._learn)
        return ids, ends[np.array(starts)]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


def piece_model(path: str) -> PieceModel:
    return per_process("pieces", path, lambda: PieceModel(path))


def encode_column(path: str | None = None, text: str = "text"):
    """binary: the ids of a text, little-endian 32-bit integers. Null and empty texts have none."""
    path = path or model_path()

    @F.arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        model, texts, out = piece_model(path), text_bytes(column), []
        for a, b in slices([len(x) for x in texts], SLICE):
            ids, starts = model.encode(texts[a:b])
            out += [ids[x:y].astype("<i4").tobytes() for x, y in zip(starts[:-1], starts[1:], strict=True)]
        return pa.array(out, pa.binary())

    return of(F.col(text))


def decode_column(path: str | None = None, ids: str = "ids"):
    """string: the text of ids. Null ids are null; bytes that aren't UTF-8 become U+FFFD."""
    path = path or model_path()

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        model = piece_model(path)
        return pa.array([None if x is None else model.decode(np.frombuffer(x, "<i4")) for x in column.to_pylist()], pa.string())

    return of(F.col(ids))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each row of docs; other columns are ignored. Repeated rows and null doc_ids stay as they are."""
    return docs.select("doc_id", encode_column(path).alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and text of each row."""
    return encoded.select("doc_id", "ids", decode_column(path).alias("text"))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    both = decode(encode(documents(spark, sf_dir)))
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
