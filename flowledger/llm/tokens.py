"""Token ids of whole documents by a public tokenizer that drops white space."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from .common import LearnedIds, per_process, split_words

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers.
WORDS_KNOWN = 400_000
#: The id that ends each document.
END_ID = 1


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return public_tokenizers.path(name)


# The steps of the default tokenizer before its merges, as its file states them.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: What isn't printable ASCII or a Latin-1 letter; on words without it those steps are plain: no composition, no title case.
_NOT_PLAIN = "[^!-~À-ÖØ-öø-ÿ]"
#: The split on lower-cased plain words, one to a line.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-zß-öø-ÿ0-9]+")
#: Parts that go to the tokenizer in one text, and texts that go to it at once.
_PARTS_A_TEXT, _TEXTS = 100, 200


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordTokenizer:
    """encode() gives what the tokenizer gives for the whole text.

    The tokenizer cuts at white space and keeps nothing of it, and none of its steps reaches over ASCII white space, so a
    text's ids are those of its words in turn, and each word needs to be encoded only once as long as it is remembered.
    Words of plain letters and marks are cut into parts here and go to the tokenizer's own merges, new ones only and many
    in one call; all others, and all words if the tokenizer isn't built of the steps above, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        normalizers = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") if x["type"] == "Split" else x["type"] for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = normalizers == NORMALIZERS and splits == [SPLIT, "ByteLevel"] and steps["post_processor"] is None
        self.special = tuple(x["content"] for x in steps["added_tokens"])
        self.lines = Tokenizer(self.tokenizer.model)  # the merges alone, a part of a word to a line
        self.lines.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(128, 256)}
        end = self.lines.encode(letters[1], add_special_tokens=False).ids  # byte 1, which no plain word has, stands after each part
        self.end, self.end_id, self.plain = f"\n{letters[1]}\n", end[0], self.plain and len(end) == 1
        self.known = LearnedIds(np.uint32, WORDS_KNOWN)
        self.parts = LearnedIds(np.uint32, WORDS_KNOWN // 2)

    def _of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """"\\n" has no ids."""
        asked, ids, texts = [x for x in parts if x != "\n"], [], []
        for a in range(0, len(asked), _PARTS_A_TEXT):
            text = "\n".join(asked[a : a + _PARTS_A_TEXT])
            if not text.isascii():
                text = "\n".join([x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in asked[a : a + _PARTS_A_TEXT]])
            texts.append(text.replace("\n", self.end) + self.end)
        for a in range(0, len(texts), _TEXTS):
            for own in self.lines.encode_batch_fast(texts[a : a + _TEXTS], add_special_tokens=False):
                ids += own.ids
        ids = np.array(ids, np.uint32)
        ends = ids == self.end_id
        sizes = np.diff(np.flatnonzero(ends), prepend=-1) - 1
        return ids[~ends], sizes if len(asked) == len(parts) else np.insert(sizes, parts.index("\n"), 0)

    def _of_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        parts = _PARTS.findall("\n".join(words).lower())
        ids, ends = self.parts(parts, self._of_parts)
        cuts = np.flatnonzero(np.fromiter(map("\n".__eq__, parts), bool, len(parts)))
        return ids, np.diff(ends[np.concatenate([[0], cuts, [len(parts)]])])

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(pa.array(words, pa.string()), _NOT_PLAIN).to_numpy(zero_copy_only=False) | (not self.plain)
        if self.special and any("<|" in x for x in words):
            odd |= np.fromiter((any(s in x for s in self.special) for x in words), bool, len(words))
        sizes = np.zeros(len(words), np.int64)
        plain, others = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, sizes[plain] = self._of_plain([words[i] for i in plain.tolist()] if len(others) else words)
        if len(others):
            encoded = [self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in others.tolist()]
            at = np.repeat(np.cumsum(sizes)[others], list(map(len, encoded)))
            ids = np.insert(ids, at, np.fromiter(chain.from_iterable(encoded), np.uint32))
            sizes[others] = list(map(len, encoded))
        return ids, sizes

    def encode(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids start, with the end). Null: no ids."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()).cast(pa.string())
        order, words, starts = split_words(column)
        ids, ends = self.known(words.to_numpy(zero_copy_only=False).tolist(), self._learn, order)
        return ids, ends[starts]

    def encode_ended(self, texts: pa.Array | list[bytes], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with end_id after each text's ids."""
        ids, starts = self.encode(texts)
        ended = np.insert(ids, starts[1:], np.uint32(end_id)) if len(texts) else ids
        return ended, starts + np.arange(len(starts))


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer of a path for the life of a Python worker."""
    return per_process("tokens", path, lambda: WordTokenizer(path))
