"""Masked pseudo-likelihood of documents by a bidirectional window network.

Words fall into classes: the most frequent words of the corpus have one each, the others share one for each shape. The
network sees the classes left and right of a masked word, joins their vectors in a hidden layer, and gives each class a
probability: softmax(tanh(left[l] + right[r] + b) @ out + c). Within its class a word has the share of its count in the
corpus, so every word is predicted and the vocabulary grows with the corpus. A document's score is the sum of

    log P(class of the word | classes left and right) + log P(word | its class)

over all its words. The corpus is counted in full: first its words, which stay a table, then every (left, class, right).
The counts are what the network is trained on, so each training step is the exact gradient over all documents; Spark
tasks work out parts of it in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_SLICE, documents, partitions, per_process, slices, split_words, staged, text_sizes

#: Classes with the boundary (0, only ever seen as a neighbour) and SHAPES shape classes; the rest are words.
CLASSES, SHAPES = 256, 15
HIDDEN, ROUNDS, RATE = 32, 40, 0.08
#: Parts of the counts. The table has at most CLASSES**3 counts, so their number needn't grow.
BUCKETS, TRAINERS = 1024, 8
#: Windows that a task counts at once.
HELD_WINDOWS = 4 << 20
#: Bytes of text whose words are asked for at once.
ASKED_SLICE = 6 << 20

_UPPER, _LOWER, _DIGIT, _OTHER = 1, 2, 4, 8
_KIND_OF_BYTE = np.full(256, _OTHER, np.uint8)
_KIND_OF_BYTE[65:91] = _UPPER
_KIND_OF_BYTE[97:123] = _KIND_OF_BYTE[128:] = _LOWER
_KIND_OF_BYTE[48:58] = _DIGIT


def shape_classes(words: pa.Array) -> np.ndarray:
    """1 to 15 for each word: lower case, capitalised, upper case, with digits, other; times up to 4 bytes, up to 8, longer."""
    if not len(words):
        return np.empty(0, np.int32)
    words = words.cast(pa.binary() if pa.types.is_string(words.type) else pa.large_binary())
    width = np.int32 if pa.types.is_binary(words.type) else np.int64
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, width)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    kinds = _KIND_OF_BYTE[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    whole, first = np.bitwise_or.reduceat(kinds, starts), kinds[starts]
    kinds[starts] = 0
    rest = np.bitwise_or.reduceat(kinds, starts)
    kind = np.select([whole & _DIGIT > 0, whole == _LOWER, whole == _UPPER, (first == _UPPER) & (rest == _LOWER)], [3, 0, 2, 1], 4)
    return (1 + 3 * kind + (sizes > 4) + (sizes > 8)).astype(np.int32)


class WordClasses:
    def __init__(self, vocabulary: list[bytes]):
        self.fixed = pa.array(vocabulary, pa.large_binary())

    def of(self, words: pa.Array) -> np.ndarray:
        fixed = pc.index_in(words.cast(pa.large_binary()), value_set=self.fixed).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(fixed < 0, shape_classes(words), 1 + SHAPES + fixed).astype(np.int32)


class Windows:
    """All words of some texts: contexts (left * CLASSES + right), classes, and which text each word is of."""

    def __init__(self, column: pa.Array, classes: WordClasses):
        self.places, self.words, ends = split_words(column)
        self.sizes = np.diff(ends)
        self.of_words = classes.of(self.words)
        self.classes = self.of_words[self.places]
        self.texts = np.repeat(np.arange(len(column)), self.sizes)
        with_bounds = np.zeros(len(self.classes) + len(column) + 1, np.int32)
        at = np.arange(len(self.classes)) + self.texts + 1
        with_bounds[at] = self.classes
        self.contexts = with_bounds[at - 1] * CLASSES + with_bounds[at + 1]


def _text_slices(column: pa.Array, limit: int = ARROW_SLICE) -> Iterator[pa.Array]:
    for a, b in slices(text_sizes(column), limit):
        yield column.slice(a, b - a)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for column in _text_slices(batch.column(0)):
            places, words, _ = split_words(column)
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(places, minlength=len(words)).astype(np.int64))], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in all documents."""
    return docs.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int = CLASSES - 1 - SHAPES) -> list[bytes]:
    """The most frequent words of word_counts, ties in byte order: size words at most, so few enough for the driver."""
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def class_sizes(counts: DataFrame, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, different words) of each class: CLASSES numbers each."""

    @F.arrow_udf("int")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(per_process("lm", tuple(words), lambda: WordClasses(words)).of(column))

    seen, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy(of("word").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        seen[r["c"]], kinds[r["c"]] = r["n"], r["k"]
    return seen, kinds


def _count_windows(words: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = per_process("lm", tuple(words), lambda: WordClasses(words))
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = codes // CLASSES % BUCKETS
            order = np.argsort(bucket, kind="stable")
            codes, counts = codes[order].astype(np.int32), counts[order].astype(np.int64)
            at = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            some = np.flatnonzero(np.diff(at))
            cut = lambda x: pa.array([x[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), cut(codes), cut(counts)], names=["bucket", "codes", "counts"])

        for batch in batches:
            for column in _text_slices(batch.column(0)):
                own = Windows(column, classes)
                held.append(own.contexts * CLASSES + own.classes)
                n += len(own.classes)
                if n >= HELD_WINDOWS:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    return run


def _sum_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> one row for each bucket. A bucket has at most CLASSES**3 / BUCKETS counts."""
    at, codes, counts = None, np.empty(0, np.int32), np.empty(0, np.int64)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["bucket", "codes", "counts"])
    for batch in batches:
        for k, c, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if k != at:
                if at is not None:
                    yield row()
                at, codes, counts = k, np.empty(0, np.int32), np.empty(0, np.int64)
            both = np.concatenate([codes, np.frombuffer(c, np.int32)])
            codes, inverse = np.unique(both, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, np.frombuffer(n, np.int64)]), len(codes)).astype(np.int64)
    if at is not None:
        yield row()


def window_counts(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(bucket, codes, counts): how often each (left, right, class) occurs in all documents."""
    parts = docs.select("text").mapInArrow(_count_windows(words), "bucket int, codes binary, counts binary")
    return parts.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(_sum_windows, "bucket int, codes binary, counts binary")


@dataclass
class WindowNetwork:
    words: list[bytes]
    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    prior: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.left, self.right, self.bias, self.out, self.prior]

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """A row for each context, a column for each class; the boundary has none."""
        hidden = np.tanh(self.left[contexts // CLASSES] + self.right[contexts % CLASSES] + self.bias)
        logits = hidden @ self.out + self.prior
        logits[:, 0] = -np.inf
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def table(self) -> np.ndarray:
        """log_probabilities of all contexts, CLASSES**3 single floats."""
        out = np.empty((CLASSES**2, CLASSES), np.float32)
        for a in range(0, CLASSES**2, 1024):
            out[a : a + 1024] = self.log_probabilities(np.arange(a, a + 1024))
        return out

    def key(self) -> str:
        return hashlib.md5(b"".join(x.tobytes() for x in self.parameters())).hexdigest()

    def gradient(self, codes: np.ndarray, counts: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Of the summed negative log-likelihood of the counted windows."""
        total, sums = 0.0, [np.zeros(x.shape) for x in self.parameters()]
        contexts, row = np.unique(codes // CLASSES, return_inverse=True)
        for a in range(0, len(contexts), 4096):
            own = slice(*np.searchsorted(row, [a, a + 4096]))  # codes ascend
            some = contexts[a : a + 4096]
            seen = np.zeros((len(some), CLASSES))
            seen[row[own] - a, codes[own] % CLASSES] = counts[own]
            logs = self.log_probabilities(some)
            total -= (seen[:, 1:] * logs[:, 1:]).sum()
            error = np.exp(logs) * seen.sum(axis=1, keepdims=True) - seen
            hidden = np.tanh(self.left[some // CLASSES] + self.right[some % CLASSES] + self.bias)
            back = (error @ self.out.T) * (1 - hidden**2)
            np.add.at(sums[0], some // CLASSES, back)
            np.add.at(sums[1], some % CLASSES, back)
            sums[2] += back.sum(axis=0)
            sums[3] += hidden.T @ error
            sums[4] += error.sum(axis=0)
        return total, sums


def _gradients(network: WindowNetwork):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, sums = 0.0, 0, None
        for batch in batches:
            for codes, counts in zip(*(batch.column(x).to_pylist() for x in ("codes", "counts")), strict=True):
                codes, counts = np.frombuffer(codes, np.int32), np.frombuffer(counts, np.int64)
                loss, own = network.gradient(codes, counts)
                total, n = total + loss, n + int(counts.sum())
                sums = own if sums is None else [x + y for x, y in zip(sums, own, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n]), pa.array([np.concatenate([x.ravel() for x in sums]).tobytes()], pa.binary())], names=["loss", "n", "gradient"])

    return run


@dataclass
class LanguageModel:
    """The network, the table of word_counts, and the occurrences and different words of each class."""

    network: WindowNetwork
    counts: DataFrame
    seen: np.ndarray
    kinds: np.ndarray

    def word_log_probability(self, n, word_class):
        """Column of log P(word | class) from a word's count (null: not in the corpus) and shape class. One occurrence more
        than it has different words is a class's share for all that the corpus lacks."""
        per_class = lambda x: F.element_at(F.array(*(F.lit(float(k)) for k in x[1 : 1 + SHAPES])), word_class)
        return F.log(F.coalesce(n.cast("double"), per_class(self.kinds + 1)) / per_class(self.seen + self.kinds + 1))


def train(docs: DataFrame, rounds: int = ROUNDS, hidden: int = HIDDEN, rate: float = RATE, seed: int = 7) -> tuple[LanguageModel, list[float]]:
    """The model, and the mean negative log-likelihood of a word's class before each round. Adam steps on the gradient
    over all documents; a round's parts come to the driver as TRAINERS rows of the network's size."""
    known = staged(word_counts(docs), "words")
    words = vocabulary(known)
    counts = staged(window_counts(docs, words).repartition(TRAINERS, "bucket"), "windows")
    counts = counts.coalesce(TRAINERS)
    draw = np.random.default_rng(seed)
    network = WindowNetwork(words, *(draw.normal(0, 0.3, x) for x in ((CLASSES, hidden), (CLASSES, hidden))), np.zeros(hidden), draw.normal(0, 0.1, (hidden, CLASSES)), np.zeros(CLASSES))
    first, second, losses = [np.zeros(x.shape) for x in network.parameters()], [np.zeros(x.shape) for x in network.parameters()], []
    for step in range(1, rounds + 1):
        parts = counts.mapInArrow(_gradients(network), "loss double, n long, gradient binary").collect()
        n = sum(r["n"] for r in parts)
        if not n:
            break  # no word in the corpus
        losses.append(sum(r["loss"] for r in parts) / n)
        flat = np.sum([np.frombuffer(r["gradient"]) for r in parts], axis=0) / n
        at = 0
        pace = rate * min(1.0, 2 * (1 - (step - 1) / rounds))
        for x, m, v in zip(network.parameters(), first, second, strict=True):
            g = flat[at : at + x.size].reshape(x.shape)
            at += x.size
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LanguageModel(network, known, *class_sizes(known, words)), losses


def _requests(network: WindowNetwork, key: str):
    """Texts -> rows of slices of texts: one with the documents of the slice, their words and their sums of
    log P(class | both sides), under a key that is no word (it has a space), and one for each word of a shape class: in
    which documents, how often. The place of the first row is even, that of the others is the next number. The documents'
    columns travel as the bytes of one Arrow stream, since a list column makes every row slow on its way to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = per_process("lm", key, network.table)
        classes = per_process("lm", tuple(network.words), lambda: WordClasses(network.words))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            start = 0
            for column in _text_slices(batch.column(1), ASKED_SLICE):
                number, n = number + 1, len(column)
                ids = batch.column(0).slice(start, n)
                start += n
                own = Windows(column, classes)
                sums = np.bincount(own.texts, table[own.contexts, own.classes], n)
                some = own.classes <= SHAPES
                pairs, times = np.unique(own.places[some].astype(np.int64) * n + own.texts[some], return_counts=True)
                word, first = np.unique(pairs // n, return_index=True)
                ends = np.append(first, len(pairs)).astype(np.int64) * 8
                posted = np.stack([pairs % n, times], axis=1).astype(np.int32)
                posted = pa.Array.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(ends), pa.py_buffer(posted)]).cast(pa.binary())
                none = len(word)
                held = pa.RecordBatch.from_arrays([ids, pa.array(own.sizes.astype(np.int64)), pa.array(sums.astype(np.float64))], names=["doc_id", "n_words", "sum"])
                stream = pa.BufferOutputStream()
                with pa.ipc.new_stream(stream, held.schema) as writer:
                    writer.write_batch(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(2 * number + (np.arange(1 + none) > 0)),
                        pa.concat_arrays([pa.array([b" %d" % number], pa.binary()), own.words.take(pa.array(word)).cast(pa.binary())]),
                        pa.array(np.append(0, own.of_words[word]).astype(np.int32), mask=np.arange(1 + none) == 0),
                        pa.concat_arrays([pa.array([stream.getvalue().to_pybytes()], pa.binary()), posted]),
                    ],
                    names=["place", "word", "class", "posted"],
                )

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place -> the documents of each slice with the sums of both parts."""
    ids = sizes = sums = None

    def rows() -> pa.RecordBatch:
        mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sums), mean], names=["doc_id", "n_words", "log_likelihood", "mean_log_prob"])

    for batch in batches:
        log, posted = batch.column("log"), batch.column("posted")
        heads = np.flatnonzero(log.is_null().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([0, *heads], [*heads, len(log)], strict=True):
            if b > a and not log[a].is_valid:
                if sums is not None:
                    yield rows()
                ids, sizes, sums = pa.ipc.open_stream(posted[a].as_buffer()).read_next_batch().columns
                sizes, sums = sizes.to_numpy(), sums.to_numpy().copy()
                a += 1
            if b > a:
                some = posted.slice(a, b - a)
                pairs = np.frombuffer(b"".join(some.to_pylist()), np.int32).reshape(-1, 2)
                each = np.repeat(log.slice(a, b - a).to_numpy(), pc.binary_length(some).to_numpy() // 8)
                sums += np.bincount(pairs[:, 0], each * pairs[:, 1], len(sums))
    if sums is not None:
        yield rows()


def score_likelihood(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, n_words, log_likelihood (summed over all words, each from both sides) and mean_log_prob (null without
    words) of each row of docs; other columns are ignored. Null and empty texts have no words and log-likelihood 0.
    Repeated rows are scored each; no rows give none. Whole texts count. docs should be read from files, so that a task
    that runs again sees the same slices of texts.

    A slice of texts asks for each of its words once. The words meet their counts in a join, and the answers go back to
    the documents by slice: a word of the whole corpus is a row for each slice, not for each place where it stands.
    """
    kind = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", "text")
    asked = texts.mapInArrow(_requests(model.network, model.network.key()), "place long, word binary, class int, posted binary")
    known = asked.join(model.counts, "word", "left")
    log = F.when(F.col("class").isNotNull(), model.word_log_probability(F.col("n"), F.col("class")))
    answers = known.select("place", log.alias("log"), "posted")
    # one integer to sort by, so that Spark sorts by radix and compares no rows
    sorted_ = answers.repartition(partitions(docs.sparkSession), F.shiftright("place", 1)).sortWithinPartitions("place")
    return sorted_.mapInArrow(_scores, f"doc_id {kind.simpleString()}, n_words long, log_likelihood double, mean_log_prob double")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, _ = train(docs)
    return score_likelihood(docs, model)
