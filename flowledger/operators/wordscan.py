"""Many words against many texts: one automaton of all words (Aho-Corasick), one pass over each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Most words, and most of their characters, that go to the workers.
MAX_WORDS, MAX_LETTERS = 100_000, 16_000_000

_automata: dict = {}


def _automaton(number: str, words: list[str]):
    """One automaton for the life of a worker or until another list of words comes."""
    if number not in _automata:
        import ahocorasick

        _automata.clear()
        own = ahocorasick.Automaton()
        for k, word in enumerate(words):
            own.add_word(word, k)
        own.make_automaton()
        _automata[number] = own
    return _automata[number]


def words_in(rows: DataFrame, text: str, words: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """rows without text, with term and hits: a row for each different word (the first column of words) that the text holds, and
    how often side by side, as str.count() has it. Capitals count.

    Null texts, and null and empty words, give nothing. The words are collected and sent to the workers: more than most, or of
    more than MAX_LETTERS characters together, are an error.
    """
    spark, keys = rows.sparkSession, [x for x in rows.columns if x != text]
    word = F.col(words.columns[0])
    asked = words.select(word.alias("w")).where((word.isNotNull()) & (word != "")).distinct().limit(most + 1)
    if (size := asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("w")), F.lit(0)).alias("letters")).first())["n"] > most or size["letters"] > MAX_LETTERS:
        raise ValueError(f"over {most} words, or over {MAX_LETTERS} characters of them")
    own = sorted(r["w"] for r in asked.collect())
    shared, number = spark.sparkContext.broadcast(own), uuid.uuid4().hex
    schema = StructType([*(rows.schema[x] for x in keys), StructField("term", StringType()), StructField("hits", LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        automaton = _automaton(number, names) if names else None
        for batch in batches:
            at, terms, hits = [], [], []
            # one text at a time: a batch's texts aren't held twice
            for i, own_text in enumerate(batch.column(0) if automaton else ()):
                if not (body := own_text.as_py()):
                    continue
                found: dict[int, list[int]] = {}  # word: how often, where the last one ends
                for end, k in automaton.iter(body):
                    seen = found.setdefault(k, [0, -1])
                    if end - len(names[k]) >= seen[1]:
                        seen[0], seen[1] = seen[0] + 1, end
                at += [i] * len(found)
                terms += [names[k] for k in found]
                hits += [n for n, _ in found.values()]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j + 1).take(take) for j in range(len(keys))), pa.array(terms, pa.string()), pa.array(hits, pa.int64())], names=schema.names)

    return rows.select(text, *keys).mapInArrow(scan, schema)
