"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

A text, with a space before it, is cut before every single space between two other characters: neither tokenizer has a
token across such a place, so the tokens of these units, laid end to end, are those of the text. Units that are not known
yet are tokenized by both, and the ends of all their tokens are two ascending sequences of byte offsets, A and B.

The path that merges A and B is cut into pieces of equal work: a binary search along each diagonal finds how many tokens
of A and of B come before it. Every piece then merges its own part, whatever unit or document that belongs to, and emits
where a token of A and one of B end together: these are the links. Pieces count their groups from 0; the sums of the
pieces before them stitch these into groups that run over a piece's border.

How often a pair of ids is linked in the whole corpus is a table that stays distributed. The pairs that hold more than a
HOT_SHARE-th of all links, of which there can be HOT_SHARE at most, go to all tasks; documents meet the others in a join.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, per_process, slices, small_batches, staged, text_sizes

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Steps of a piece of the path.
STEPS = 64
#: Bytes of text that a task aligns at once.
SLICE = 2 << 20
#: Bytes of links that a task counts at once.
COUNTED = 2 << 20
#: Units, and bytes of what is known of them, that a worker remembers; longer units aren't remembered.
UNITS, KNOWN_BYTES, LONG_UNIT = 80_000, 16 << 20, 256
#: Bytes of new units that are tokenized together.
NEW = 1 << 19
HOT_SHARE = 1 << 18
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"


# ---------------------------------------------------------------- the merge


def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """How many of a are among the first 0, steps, 2 * steps ... of a and b merged (a first among equals), and of all."""
    total = len(a) + len(b)
    cut = np.append(np.arange(0, total, steps), total)
    low, high = np.maximum(0, cut - len(b)), np.minimum(cut, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        taken = a[middle] <= b[cut[open_] - 1 - middle]
        low[open_] = np.where(taken, middle + 1, low[open_])
        high[open_] = np.where(taken, high[open_], middle)
    return low


def merge_groups(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b: strictly ascending ends -> (group of each token of a, group of each token of b, places of a that end with one of
    b). A group ends where tokens of both end; the k-th link ends group k."""
    from_a = diagonals(a, b, steps)
    n = len(from_a) - 1
    far = np.iinfo(np.int64).max
    a_, b_ = np.append(a, far), np.append(b, far)
    total = len(a) + len(b)
    i, j, own = from_a[:-1].copy(), np.minimum(np.arange(n) * steps, total) - from_a[:-1], np.zeros(n, np.int64)
    ga, gb, ends = np.empty(len(a), np.int64), np.empty(len(b), np.int64), np.zeros(len(a), bool)
    for step in range(steps):
        if step == total - (n - 1) * steps:  # the last piece is shorter
            i_, j_, own_ = i[:-1], j[:-1], own[:-1]
        elif step == 0:
            i_, j_, own_ = i, j, own
        if not len(i_):
            break
        take = a_[i_] <= b_[j_]
        at, other = i_[take], j_[~take]
        ga[at], gb[other] = own_[take], own_[~take]
        before = i_[~take] - 1  # the piece before this one may have taken it
        together = (before >= 0) & (a_[before] == b_[other])
        ends[before[together]] = True
        i_ += take
        j_ += ~take
        own_[np.flatnonzero(~take)[together]] += 1
    # stitch: what the pieces before have counted
    offset = np.concatenate([[0], np.cumsum(own)[:-1]]) if n else own
    ga += np.repeat(offset, np.diff(from_a))
    gb += np.repeat(offset, np.diff(np.append(np.arange(n) * steps, total) - from_a))
    return ga, gb, np.flatnonzero(ends)


# ---------------------------------------------------------------- tokens


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself where it prints, else letters from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(others)}


def _by_ranks(tokenizer, tokens: list[bytes]):
    """The same merges by ranks, which is faster for short texts; None if the ids aren't the order of the merges, or the
    tokenizer does more than merge bytes."""
    import json

    import tiktoken

    steps = json.loads(tokenizer.to_str())
    model, split = steps["model"], steps["pre_tokenizer"] or {}
    merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model.get("merges", [])]
    if steps["normalizer"] or steps["post_processor"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        return None
    if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or any(model["vocab"].get(x) != 256 + k for k, x in enumerate(merged)):
        return None
    ranks = {tokens[i]: i for i in model["vocab"].values()}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """What both tokenizers make of units, and how their tokens meet."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = _byte_of()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        bytes_a = [bytes([letters[c] for c in x]) if all(c in letters for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        if any(c == "▁" for i, x in enumerate(pieces) if not self.b.is_control(i) and x.strip("▁") for c in x[1:]):
            raise ValueError("a piece holds a space mark after another character")
        self.fast_a = _by_ranks(self.a, bytes_a)
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.binary()), pa.array(bytes_b, pa.binary())
        # each id in decimal, as it stands inside a group and at the end of its side of one
        numbers = lambda n, ends: [f"{i}{end}".encode() for end in ends for i in range(n)]
        self.decimals = pa.array(numbers(len(bytes_a), ",|") + numbers(len(bytes_b), ",;"), pa.binary())
        # of each remembered unit: its place in what follows; groups, links; (tokens of A, of B, links, whether both give it back)
        self.place: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.links: list[bytes] = []
        self.numbers = np.empty((0, 4), np.int64)
        self.uses = np.empty(0, np.int64)
        self.held = 0

    def _joined(self, of: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of tokens one after another, where each token ends)."""
        taken = of.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
        data = taken.buffers()[2]
        return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8), (ends[1:] - ends[0]).astype(np.int64)

    def _tokens_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, number of ids of each)."""
        plain = np.zeros(len(units), bool)
        if self.fast_a is not None:  # units that stand between safe places go in one text, and are told apart by their bytes
            plain = np.fromiter((1 < len(x) <= LONG_UNIT and not x[1].isspace() and not x[-1].isspace() for x in units), bool, len(units))
        own = [x for x, p in zip(units, plain.tolist(), strict=True) if p]
        ids = list(chain.from_iterable(self.fast_a.encode_ordinary("".join(own[k : k + 200])) for k in range(0, len(own), 200)))
        flat = np.array(ids, np.int64)
        _, ends = self._joined(self.bytes_a, flat)
        n = np.zeros(len(units), np.int64)
        n[plain] = np.diff(np.searchsorted(ends, np.cumsum(np.fromiter((len(x.encode()) for x in own), np.int64, len(own)))) + 1, prepend=0)
        others = np.flatnonzero(~plain)
        if len(others):
            encoded = [x.ids for x in self.a.encode_batch_fast([units[k] for k in others.tolist()], add_special_tokens=False)]
            at = np.repeat(np.cumsum(n)[others], list(map(len, encoded)))
            flat = np.insert(flat, at, np.fromiter(chain.from_iterable(encoded), np.int64))
            n[others] = list(map(len, encoded))
        return flat, n

    def _tokens_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.b.encode([x[1:] for x in units], num_threads=1)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n

    def align_units(self, units: list[str]) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """groups, links and numbers (tokens of A, of B, links, 1) of units, each of which begins with a space; nothing and
        zeros where the bytes of either's tokens aren't the unit's."""
        whole = [x.encode() for x in units]
        all_bytes, sizes = b"".join(whole), np.fromiter(map(len, whole), np.int64, len(whole))
        sides, ok = [], np.ones(len(units), bool)
        for (flat, n), of in ((self._tokens_a(units), self.bytes_a), (self._tokens_b(units), self.bytes_b)):
            data, ends = self._joined(of, flat)
            last = np.concatenate([[0], ends])[np.cumsum(n)]
            if not np.array_equal(np.diff(last, prepend=0), sizes) or data.tobytes() != all_bytes:
                cuts = np.concatenate([[0], last]).tolist()
                for k, x in enumerate(whole):
                    ok[k] &= data[cuts[k] : cuts[k + 1]].tobytes() == x
            sides.append((flat, n, np.diff(ends, prepend=0)))
        # tokens of units that both give back; their ends, one unit after another
        (a, na, size_a), (b, nb, size_b) = [(flat[(keep := np.repeat(ok, n))], np.where(ok, n, 0), size[keep]) for flat, n, size in sides]
        ga, gb, at = merge_groups(np.cumsum(size_a), np.cumsum(size_b))
        last_b = np.searchsorted(gb, np.arange(len(at)), "right") - 1
        codes = ((a[at] << 32) | b[last_b]).astype("<i8").tobytes()
        links = np.searchsorted(at, np.concatenate([[0], np.cumsum(na)]))  # links before each unit
        # groups as text: the tokens of A and B of a group in turn
        end_a, end_b = np.append(ga[1:] != ga[:-1], True)[: len(a)], np.append(gb[1:] != gb[:-1], True)[: len(b)]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(gb, ga)] = a + len(self.bytes_a) * end_a
        order[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = 2 * len(self.bytes_a) + b + len(self.bytes_b) * end_b
        text, ends = self._joined(self.decimals, order)
        text = text.tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(na + nb)])].tolist()
        at_links = (8 * links).tolist()
        runs = lambda data, at: [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        return runs(text, cuts), runs(codes, at_links), np.stack([na, nb, np.diff(links), ok.astype(np.int64)], axis=1)

    def of(self, units: list[str]) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """align_units() of different units, most of which were seen before."""
        places = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        lacking = np.flatnonzero(places < 0).tolist()
        for a, b in slices([len(units[k]) for k in lacking], NEW):
            own = [units[k] for k in lacking[a:b]]
            groups, links, numbers = self.align_units(own)
            first = len(self.groups)
            places[lacking[a:b]] = np.arange(first, first + len(own))
            self.place.update(zip(own, range(first, first + len(own)), strict=True))
            self.groups += groups
            self.links += links
            self.numbers = np.concatenate([self.numbers, numbers])
            self.uses = np.concatenate([self.uses, np.zeros(len(own), np.int64)])
            self.held += sum(map(len, own)) + sum(map(len, groups)) + sum(map(len, links))
        self.uses[places] += 1
        at = places.tolist()
        out = [self.groups[k] for k in at], [self.links[k] for k in at], self.numbers[places]
        if len(self.place) > UNITS or self.held > KNOWN_BYTES:
            self._shrink()
        return out

    def _shrink(self) -> None:
        """Keeps what was used most often, up to half of the limits, and no long units."""
        units = list(self.place)
        sizes = np.fromiter((len(u) + len(g) + len(x) for u, g, x in zip(units, self.groups, self.links, strict=True)), np.int64, len(units))
        short = np.fromiter((len(u) <= LONG_UNIT for u in units), bool, len(units))
        kept = np.argsort(-self.uses, kind="stable")
        kept = kept[short[kept]]
        kept = np.sort(kept[np.cumsum(sizes[kept]) <= KNOWN_BYTES // 2][: UNITS // 2])
        at = kept.tolist()
        self.place = {units[k]: n for n, k in enumerate(at)}
        self.groups, self.links = [self.groups[k] for k in at], [self.links[k] for k in at]
        self.numbers, self.uses, self.held = self.numbers[kept], self.uses[kept] // 2, int(sizes[kept].sum())

    def units(self, column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(place of each unit among the different ones, these, where each text's units start, with the end). A text that is
        null or empty has one unit, of one space."""
        split = pc.split_pattern(pc.fill_null(column, ""), " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        starts, coded = starts - starts[0], split.flatten().dictionary_encode()
        parts, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        one = lambda x: pc.utf8_is_space(x).to_numpy(zero_copy_only=False) | (pc.binary_length(x).to_numpy(zero_copy_only=False) == 0)
        edge = [one(pc.utf8_slice_codeunits(parts, start, stop)) for start, stop in ((0, 1), (-1, None))]
        own = np.zeros(len(at) + 1, bool)  # whether a unit starts with this part
        own[1:-1] = ~(edge[1][at[:-1]] | edge[0][at[1:]])
        own[starts] = True
        own = own[:-1]
        first = np.flatnonzero(own)
        n = np.diff(np.append(first, len(at)))
        names = [" " + x for x in parts.to_pylist()]
        place = at[first]
        long = np.flatnonzero(n > 1)
        if len(long):
            known: dict[str, int] = {}
            for k, a, m in zip(long.tolist(), first[long].tolist(), n[long].tolist(), strict=True):
                place[k] = known.setdefault("".join([names[x] for x in at[a : a + m].tolist()]), len(names) + len(known))
            names += known
        used, place = np.unique(place, return_inverse=True)
        return place, [names[k] for k in used.tolist()], np.searchsorted(first, starts)

    def align_texts(self, column: pa.Array) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups, links of each text."""
        place, units, starts = self.units(column)
        groups, links, numbers = self.of(units)
        bad = np.add.reduceat(numbers[place, 3] == 0, starts[:-1]) > 0 if len(column) else np.zeros(0, bool)
        bad |= np.array(text_sizes(column)) == 0
        n = np.where(bad, 0, np.diff(starts))
        place = place[np.repeat(~bad, np.diff(starts))]
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = [np.concatenate([[0], np.cumsum(numbers[place, k])])[ends] for k in range(3)]
        out = [pa.array(np.diff(sums[k])) for k in (0, 1, 2, 2)]
        for x, kind in ((groups, pa.string()), (links, pa.binary())):
            taken = pa.array(x, pa.binary()).take(pa.array(place))
            offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1][ends]
            data = taken.buffers()[2]
            out.append(pa.Array.from_buffers(kind, len(column), [None, pa.py_buffer(np.ascontiguousarray(offsets)), data if data is not None else pa.py_buffer(b"")]))
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for the life of a Python worker."""
    return per_process("alignment", (path_a, path_b), lambda: Aligner(path_a, path_b))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, links of each row of docs.

    A encodes a space and the text, B the text (before which it puts a space itself), neither with special tokens. groups:
    `a1,a2|b1;a3|b2,b3;` in decimal ids, every group ended by a semicolon; links: a little-endian 64-bit integer for each,
    the id of A in its upper half, that of B in its lower. Texts that are null or empty, or whose tokens' bytes aren't the
    text's for A or B (as with a U+2581 in it), have no tokens: zeros, an empty string and no bytes. Repeated rows and null
    doc_ids stay as they are; other columns are ignored; an empty table gives an empty one.
    """
    path_a, path_b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for a, b in slices(text_sizes(batch.column(1)), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *own.align_texts(batch.column(1).slice(a, b - a))], names=[x.split()[0] for x in ALIGNED.split(", ")])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


# ---------------------------------------------------------------- counts over the corpus


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """links -> (code, n) of each slice of them."""
    held, size = [], 0
    per_process("alignment-counts", None, dict)  # what is known of units goes

    def sums(parts: list) -> pa.RecordBatch:
        codes, n = np.unique(np.frombuffer(b"".join(parts), "<i8"), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(x)
            size += len(x)
            if size > COUNTED:
                yield sums(held)
                held, size = [], 0
    if held:
        yield sums(held)
    give_back()


def link_counts(aligned: DataFrame) -> DataFrame:
    """(code, n, best): how many links of the corpus hold a pair of ids, and whether no pair with its id of B has more."""
    counts = aligned.select("links").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    with small_batches(aligned.sparkSession):
        counts = staged(counts, "link-counts")
    own = F.expr("code & 4294967295").alias("b")
    most = counts.groupBy(own).agg(F.max("n").alias("most"))
    return staged(counts.select("code", "n", own).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "best-links")


def _looked_up(codes: np.ndarray, n: np.ndarray, best: np.ndarray):
    """(row, links) -> (row, n_best, count_sum, rest): sums over the links whose pair is among codes; rest has the others as
    (code, times) with times in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_process("alignment-counts", None, dict)
        padded = np.append(codes, np.int64(-1))
        weights = [np.append(x, 0) for x in (best.astype(np.int64), n)]
        for batch in batches:
            links = batch.column(1)
            sizes = pc.binary_length(links).to_numpy() // 8
            for a, b in slices((8 * sizes).tolist(), COUNTED):
                own = np.frombuffer(b"".join(links.slice(a, b - a).to_pylist()), "<i8")
                starts = np.concatenate([[0], np.cumsum(sizes[a:b])])
                at = np.searchsorted(codes, own)
                hit = padded[at] == own
                at = np.where(hit, at, len(codes))
                sums = [np.diff(np.concatenate([[0], np.cumsum(w[at])])[starts]) for w in weights]
                rest = np.flatnonzero(~hit)
                doc = np.searchsorted(starts, rest, "right") - 1
                cuts = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(cuts), pa.array(own[rest], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sums[0]), pa.array(sums[1]), column], names=["row", "n_best", "count_sum", "rest"])
        give_back()

    return run


def with_counts(aligned: DataFrame) -> DataFrame:
    """aligned, staged rows of align() with a column row that tells them apart, with n_best and count_sum in place of links:
    how many links are of a pair that no other pair with its id of B exceeds in the corpus, and the sum of the counts."""
    spark, counts = aligned.sparkSession, link_counts(aligned)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = total // HOT_SHARE + 1
    hot = counts.where(F.col("n") >= least).orderBy("code").toArrow()  # at most HOT_SHARE rows
    codes, n, best = (hot.column(c).to_numpy() for c in ("code", "n", "best"))
    # the tables go to each executor once
    shared = spark.sparkContext.broadcast((codes, n, best))

    def look(batches):
        return _looked_up(*shared.value)(batches)

    with small_batches(spark):
        found = staged(aligned.select("row", "links").mapInArrow(look, "row long, n_best long, count_sum long, rest array<long>"), "link-sums")
    asked = found.where(F.size("rest") > 0).select("row", F.explode("rest").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times"))
    rare = counts.where(F.col("n") < least)
    more = asked.join(rare, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more"), F.sum(F.col("times") * F.col("n")).alias("sum_more"))
    sums = found.select("row", "n_best", "count_sum").join(more, "row", "left")
    sums = sums.select("row", (F.col("n_best") + F.coalesce("best_more", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum_more", F.lit(0))).alias("count_sum"))
    return aligned.drop("links").join(sums, "row").drop("row")


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.rtrim(F.col("groups"), F.lit(";")).cast("binary"), 256))
    aligned = align(documents(spark, sf_dir)).withColumn("groups_sha256", digest).drop("groups")
    with small_batches(spark):
        aligned = staged(aligned.select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")
    return with_counts(aligned)
