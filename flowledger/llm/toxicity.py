"""Toxicity: cumulative-link ordinal regression over the words of a text.

P(grade > k) = 1 / (1 + exp(cut_k - w.x)): one weight vector w for all grades, increasing cut points. x marks which of
the chosen word starts a text has; a start is a word's first 4, 6 or 8 bytes, or the word if that is shorter. The
expected severity is the sum of P(grade > k) over k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, documents, staged, struct_array, text_bytes
from .labelled import MAX_LABELLED, labelled_sample

#: Bytes that end a word besides white space.
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_BLANKED = bytes.maketrans(_MARKS, b" " * len(_MARKS))


#: Lengths of the word starts that are features.
STARTS = (4, 6, 8)
#: Most word starts of a model, and documents of the sample that must have one (fewer in a sample below 100).
MAX_WORDS, LEAST_DOCUMENTS = 2000, 5


def plain_words(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), cut at white space and ASCII punctuation."""
    return text.lower().translate(_BLANKED).split()


def starts_of(words: set[bytes]) -> set[bytes]:
    return {w[:k] for k in STARTS for w in words}


@dataclass
class OrdinalModel:
    words: np.ndarray  # XXH64 of the chosen word starts
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, signal: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - signal[:, None], -40, 40)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, max_words: int = MAX_WORDS, least_documents: int = LEAST_DOCUMENTS, l1: float = 3e-4, steps: int = 400) -> OrdinalModel:
    """rows: the different hashes of word starts of each document. Keeps the max_words starts whose share of graded documents
    departs most from the mean, then fits weights and cuts by accelerated proximal gradient steps with an L1 penalty."""
    n, top = len(rows), int(grades.max()) if len(grades) else 0
    if not n or top == 0:  # no toxic example: nothing is toxic
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.full(1, 40.0))
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(x) for x in rows])
    vocabulary, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
    bad = grades > 0
    rate = bad.mean()
    with_bad = np.bincount(index, bad[owner].astype(float), len(vocabulary))
    z = (with_bad - counts * rate) / np.sqrt(counts * rate * (1 - rate) + 1e-9)
    eligible = np.flatnonzero(counts >= min(least_documents, max(1, n // 20)))
    chosen = np.sort(eligible[np.argsort(-np.abs(z[eligible]), kind="stable")[:max_words]])
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    column = place[index]
    used = column >= 0
    column, owner = column[used], owner[used]
    per_document = max(1.0, np.bincount(owner, minlength=n).mean())

    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    w, ahead, momentum = np.zeros(len(chosen)), np.zeros(len(chosen)), 1.0
    above = grades[:, None] > np.arange(top)[None, :]
    # the likelihood of a grade is P(> g-1) - P(> g)
    step = 4.0 / (0.5 * per_document + 1)
    for _ in range(steps):
        signal = np.bincount(owner, ahead[column], n)
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - signal[:, None], -40, 40)))
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        mass = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        down = -(slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / mass
        gradient = np.bincount(column, down[owner], len(chosen)) / n
        pull = np.where(above & (np.arange(top)[None, :] == grades[:, None] - 1), slope[:, 1:-1] / mass[:, None], 0) - np.where(np.arange(top)[None, :] == grades[:, None], slope[:, 1:-1] / mass[:, None], 0)
        cuts = np.maximum.accumulate(cuts - 2.0 * pull.mean(axis=0))
        after = ahead - step * gradient
        after = np.sign(after) * np.maximum(np.abs(after) - step * l1, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = after + (momentum - 1) / following * (after - w)
        w, momentum = after, following
    kept = np.flatnonzero(w)
    return OrdinalModel(vocabulary[chosen[kept]], w[kept], cuts)


def start_hash_column(text: str = "text"):
    """array<long>: the different word starts of a text, as XXH64."""

    @F.arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for x in text_bytes(column):
            own = starts_of(set(plain_words(x)))
            rows.append(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)).view(np.int64))
        return pa.array(rows, pa.list_(pa.int64()))

    return of(F.col(text))


def _telling_words(sample: DataFrame, n: int, n_bad: int) -> np.ndarray:
    """The word starts that fit_ordinal chooses, found by Spark: a bounded number."""
    rate = n_bad / n
    counts = sample.select(F.explode("features").alias("h"), (F.col("label") > 0).cast("int").alias("bad")).groupBy("h").agg(F.count("*").alias("c"), F.sum("bad").alias("b"))
    z = (F.col("b") - F.col("c") * rate) / F.sqrt(F.col("c") * rate * (1 - rate) + 1e-9)
    some = counts.where(F.col("c") >= min(LEAST_DOCUMENTS, max(1, n // 20))).orderBy(F.desc(F.abs(z)), F.col("h").bitwiseXOR(F.lit(-(2**63)))).limit(MAX_WORDS)
    return np.array([r["h"] for r in some.select("h").collect()], np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """Fitted on at most max_labelled labelled documents. Grades: 0 not toxic, 1 toxic, 2 toxic and of bad quality. Spark
    chooses the words, so that the driver gets no other of the sample's words."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    sample = staged(labelled_sample(docs, labels, grade, start_hash_column(), max_labelled), "toxicity-sample")
    size = sample.agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("bad")).first()
    if not size["bad"]:
        return fit_ordinal([], np.empty(0, int))
    chosen = F.lit(_telling_words(sample, size["n"], size["bad"]).tolist()).cast("array<bigint>")
    rows = sample.select("doc_id", "label", F.array_intersect("features", chosen).alias("features")).toArrow().sort_by("doc_id")
    return fit_ordinal([x.values.to_numpy().view(np.uint64) for x in rows["features"]], rows["label"].to_numpy().astype(int))


def toxicity_column(model: OrdinalModel, threshold: float = 0.5, text: str = "text"):
    """A struct: severity (expected grade), p_toxic (P(grade > 0)) and toxic (p_toxic >= threshold).

    Null and empty texts have no words and so the model's prior. Each of the model's starts counts once in a text.
    """

    places = {int(h): i for i, h in enumerate(model.words)}
    known: dict[bytes, tuple] = {}  # word of bounded length -> places of its starts among the model's, in each worker

    @F.arrow_udf("struct<severity:double,p_toxic:double,toxic:boolean>")
    def of(column: pa.Array) -> pa.Array:
        texts = text_bytes(column)
        signal = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if len(known) > WORD_TABLE:
                known.clear()
            own = {word[: STARTS[-1]] for word in plain_words(text)}  # longer words have no further starts
            for word in own.difference(known):
                hits = {places.get(xxhash.xxh64_intdigest(word[:k])) for k in STARTS}
                known[word] = tuple(hits - {None})
            if found := sorted({p for places_of in map(known.__getitem__, own) if places_of for p in places_of}):
                signal[i] = model.weights[found].sum()
        p = model.above(signal)
        return struct_array(severity=p.sum(axis=1), p_toxic=np.ascontiguousarray(p[:, 0]), toxic=p[:, 0] >= threshold)

    return of(F.col(text))


def score_toxicity(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity, p_toxic and toxic for each row of docs; other columns are ignored."""
    return docs.select("doc_id", toxicity_column(model, threshold).alias("t")).select("doc_id", "t.*")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that aren't toxic."""
    return docs.where(~toxicity_column(fit_toxicity(docs, labels)).getField("toxic"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
