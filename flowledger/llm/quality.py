"""Quality rules: fixed counters of a text, and gradient-boosted trees over document statistics.

The trees are complete and flattened into numpy arrays (feature and threshold of each inner node, value of each leaf),
so that a batch of documents walks all trees at once. On chosen statistics the score can only fall as they rise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, per_process, rolling, slices, struct_array, text_bytes
from .labelled import MAX_LABELLED, labelled_sample

# Fixed values of the counters' contract.
SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: name -> direction in which it may move the score (0: freely)
STATISTICS = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "bangs_per_word": -1,
    "pipes_per_word": -1,
    "digit_share": 0,
    "distinct_share": 0,
    "lines_per_word": 0,
    "high_byte_share": 0,
}

_KIND = np.zeros((7, 256), np.int64)  # rows: white space, code point starts, symbols, upper case, letters, digits, bytes over 127
_KIND[0, [9, 10, 11, 12, 13, 32]] = 1
_KIND[1] = 1
_KIND[1, 0x80:0xC0] = 0
_KIND[2, list(SYMBOLS)] = 1
_KIND[3, 65:91] = 1
_KIND[4, 65:91] = _KIND[4, 97:123] = 1
_KIND[5, 48:58] = 1
_KIND[6, 128:] = 1


def repeated_words(hashes: np.ndarray, starts: np.ndarray, width: int = REPEAT_WIDTH) -> np.ndarray:
    """For each run of word hashes: the words in windows of width whose sequence is found twice or more in the run."""
    n = np.diff(starts)
    out = np.zeros(len(n), np.int64)
    windows = rolling(hashes, width)
    if not len(windows):
        return out
    owner = np.repeat(np.arange(len(n)), n)
    whole = owner[: len(windows)] == owner[width - 1 : width - 1 + len(windows)]
    at = np.flatnonzero(whole)
    if not len(at):
        return out
    keys = windows[at] ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[again], 1)
    np.add.at(change, at[again] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


def measure(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(counters, statistics), a row for each text."""
    words, starts, lines, distinct = [], [0], [], []
    for text in texts:
        own = text.split()
        words += own
        starts.append(len(words))
        full = [x for x in text.split(b"\n") if x.strip()]
        lines.append((len(full), len(full) - len(set(full))))
        distinct.append(len(set(own)))
    starts, lines = np.array(starts), np.array(lines).reshape(-1, 2)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    kinds = []
    for row in (*_KIND, np.arange(256) == ord("!"), np.arange(256) == ord("|")):
        total = np.concatenate([[0], np.cumsum(row.astype(np.uint8)[data], dtype=np.int64)])
        kinds.append(total[ends[1:]] - total[ends[:-1]])
    space, points, symbols, upper, letters, digits, high, bangs, pipes = kinds
    n = np.diff(starts)
    repeats = repeated_words(hashes(words), starts)
    counters = np.stack([n, points - space, symbols, lines[:, 1], repeats], axis=1)
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(ends), 1)
    statistics = np.stack(
        [
            np.log1p(n), counters[:, 1] / some, symbols / some, lines[:, 1] / np.maximum(lines[:, 0], 1), repeats / some, upper / np.maximum(letters, 1),
            bangs / some, pipes / some, digits / size, np.array(distinct) / some, lines[:, 0] / some, high / size,
        ],
        axis=1,
    )
    return counters, statistics


def base_failed(counters: np.ndarray) -> np.ndarray:
    return (counters[:, 0] < LEAST_WORDS) | (100 * counters[:, 4] > REPEAT_PERCENT * counters[:, 0])


@dataclass
class BoostedTrees:
    """Complete trees of one depth; a row goes right where its feature is over the threshold."""

    base: float
    feature: np.ndarray  # trees x inner nodes, in heap order
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        each = np.arange(trees)
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            node = np.zeros((len(rows), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                right = rows[np.arange(len(rows))[:, None], self.feature[each, node]] > self.threshold[each, node]
                node = 2 * node + 1 + right
            out[a : a + 4096] = self.base + self.value[each, node - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 20, l2: float = 1.0) -> BoostedTrees:
    """Second-order boosting of the logistic loss over quantile bins. A split on a statistic with a direction is taken
    only if its sides' values are in that order, and the sides' descendants stay on their side of the middle."""
    n, d = x.shape
    inner = 2**depth - 1
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.99
    model = BoostedTrees(float(np.log(mean / (1 - mean))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if n < 2 * least or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        weights = {0: np.clip(g.sum() / (h.sum() + l2), -np.inf, np.inf)}
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            low, high = bounds[k]
            best, split = 1e-6, None
            if len(rows) >= 2 * least:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j in range(d):
                    size = len(edges[j]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, j], minlength=size))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    wl, wr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                    gain = gl * wl - (hl + l2) * wl**2 / 2 + gr * wr - (hr + l2) * wr**2 / 2 - (total_g**2 / (total_h + l2) / 2)
                    gain[(nl < least) | (len(rows) - nl < least)] = -np.inf
                    if directions[j]:
                        gain[directions[j] * (wr - wl) < 0] = -np.inf
                    i = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[i] > best:
                        best, split = gain[i], (j, i, wl[i], wr[i])
            children = (2 * k + 1, 2 * k + 2)
            if split is None:
                weights |= dict.fromkeys(children, weights[k])
                bounds |= dict.fromkeys(children, bounds[k])
                node[rows] = children[0]
                continue
            j, i, wl, wr = split
            model.feature[t, k], model.threshold[t, k] = j, edges[j][i]
            right = binned[rows, j] > i
            node[rows] = np.where(right, children[1], children[0])
            weights |= {children[0]: wl, children[1]: wr}
            middle = (wl + wr) / 2
            bounds |= {
                children[0]: (low, middle) if directions[j] > 0 else (middle, high) if directions[j] < 0 else (low, high),
                children[1]: (middle, high) if directions[j] > 0 else (low, middle) if directions[j] < 0 else (low, high),
            }
        model.value[t] = [rate * weights[inner + leaf] for leaf in range(inner + 1)]
        margin += model.value[t][node - inner]
    return model


def statistics_column(text: str = "text"):
    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        texts, hashes = text_bytes(column), per_process("words", 0, WordHashes)
        rows = [measure(texts[a:b], hashes)[1] for a, b in slices(list(map(len, texts)))]
        flat = np.concatenate(rows).ravel() if rows else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat))

    return of(F.col(text))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> BoostedTrees:
    """Trees fitted on at most max_labelled documents with a label quality (1: good, 0: bad)."""
    rows = labelled_sample(docs, labels, F.col("quality"), statistics_column(), max_labelled).toArrow().sort_by("doc_id")
    x = np.array(rows["features"].combine_chunks().flatten(), float).reshape(-1, len(STATISTICS))
    return fit_trees(x, rows["label"].to_numpy().astype(float), list(STATISTICS.values()))


SCHEMA = ", ".join(f"{x} long" for x in COUNTERS) + ", base_failed boolean, score double, kept boolean"


def quality_column(model: BoostedTrees, threshold: float = 0.5, text: str = "text"):
    """A struct: the five counters, base_failed, score (the trees' probability of good quality) and kept.

    Null and empty texts have no words: all counters 0, base_failed true, kept false. Whole texts count, however long.
    """

    @F.arrow_udf(f"struct<{SCHEMA.replace(' long', ':long').replace(' boolean', ':boolean').replace(' double', ':double')}>")
    def of(column: pa.Array) -> pa.Array:
        texts, hashes = text_bytes(column), per_process("words", 0, WordHashes)
        parts = [measure(texts[a:b], hashes) for a, b in slices(list(map(len, texts)))] or [(np.empty((0, 5), np.int64), np.empty((0, len(STATISTICS))))]
        counters, statistics = (np.concatenate(x) for x in zip(*parts, strict=True))
        failed, score = base_failed(counters), model.probability(statistics)
        return struct_array(**{x: np.ascontiguousarray(counters[:, i]) for i, x in enumerate(COUNTERS)}, base_failed=failed, score=score, kept=~failed & (score >= threshold))

    return of(F.col(text))


def score_quality(docs: DataFrame, model: BoostedTrees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counters, base_failed, score and kept for each row of docs; other columns are ignored."""
    return docs.select("doc_id", quality_column(model, threshold).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that quality_column keeps."""
    return docs.where(quality_column(fit_quality(docs, labels)).getField("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
