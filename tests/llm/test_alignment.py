"""Two tokenizers' tokens over the same bytes, against both libraries on whole texts and a merge by sets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("flowledger.llm")
from flowledger.llm import alignment  # noqa: E402

ODD = ["", None, " a  b", "a\nb", "  ", " ", "日本 x\t y", "a▁b", "▁▁日本語テキスト" * 20, "ﬁ Ａ\x00b\x01", " \n ", "x" * 3000, "aaaa bbbb" * 30, "👍🏽 ok", "the    quick     brown", "\r\n\r\n", "it's I'LL <|endoftext|> <s> <unk> <0x41> </s>", "a  b  c \x85d \x1ce ​f", "end ", " begin", "tab\t x \ty", "don' t 's", "y " * 300, "word " * 5]


def strange_texts():
    draw = random.Random(3)
    return ODD + ["".join(draw.choice("ab  \n\tétheTh日👍.,&$#1 2' 　" + "▁" * (k % 9 == 0)) for _ in range(draw.randrange(150))) for k in range(900)]


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(alignment.public_tokenizers.path(alignment.TOKENIZER_A), alignment.public_tokenizers.path(alignment.TOKENIZER_B))


def by_sets(own, text):
    """(ids of A, ids of B, groups as lists of ids, pairs of linked ids)."""
    a, b = (own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)) if text else ([], [])
    bytes_a, bytes_b = [own.bytes_a[i].as_py() for i in a], [own.bytes_b[i].as_py() for i in b]
    if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    common = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in common]
    for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
        for i, k in zip(ids, np.searchsorted(common, ends), strict=True):
            groups[k][side].append(i)
    last_a, last_b = dict(zip(ends_a, a, strict=True)), dict(zip(ends_b, b, strict=True))
    return a, b, groups, [(last_a[x], last_b[x]) for x in common]


def as_text(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


@pytest.mark.parametrize("steps", [1, 2, 7, 64])
def test_pieces_of_the_merge_make_whole_groups(steps):
    draw = np.random.default_rng(steps)
    for _ in range(120):
        a, b = (np.unique(np.append(draw.choice(500, int(draw.integers(0, 200)), replace=False) + 1, 501)).astype(np.int64) for _ in range(2))
        ga, gb, at = alignment.merge_groups(a, b, steps)
        common = np.intersect1d(a, b)
        assert (ga == np.searchsorted(common, a)).all() and (gb == np.searchsorted(common, b)).all() and (a[at] == common).all()
        cut = alignment.diagonals(a, b, steps)
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        assert cut.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in (*range(0, len(merged), steps), len(merged))]
    none = np.empty(0, np.int64)
    assert all(len(x) == 0 for x in alignment.merge_groups(none, none))


def test_units_of_texts_equal_whole_texts(own, monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 300)  # so that units are forgotten and learned again
    texts = strange_texts()
    for batch in (texts, texts[::-1], texts[5:6], []):
        columns = own.align_texts(pa.array(batch, pa.string()))
        for text, *got, groups, links in zip(batch, *(x.to_pylist() for x in columns), strict=True):
            a, b, want, pairs = by_sets(own, text)
            assert got == [len(a), len(b), len(want), len(pairs)], text
            assert groups == as_text(want) + ";" * bool(want)
            assert [(x >> 32, x & 0xFFFFFFFF) for x in np.frombuffer(links, "<i8").tolist()] == pairs


def test_merges_by_ranks_need_the_tokenizer_to_be_plain(own):
    from tokenizers import Tokenizer

    assert own.fast_a is not None
    other = Tokenizer.from_file(alignment.public_tokenizers.path("word_bpe_49k.json"))
    assert alignment._by_ranks(other, []) is None


@pytest.mark.parametrize("hot_share", [1 << 18, 500, 1])
def test_counts_over_the_corpus(spark, own, hot_share, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_SHARE", hot_share)  # so that pairs are looked up both ways
    texts = strange_texts()[:250] + ["the cat sat. the cat sat, the dog"] * 3
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts)] + [(3, texts[3], 1, "x", 2), (None, texts[20], 1, "x", 2), (None, None, 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row int, links string, n int").repartition(3)
    from pyspark.sql import functions as F

    aligned = alignment.staged(alignment.align(docs).select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")
    got = sorted((str(r["doc_id"]), r["groups"], r["n_a"], r["n_b"], r["n_links"], r["n_best"], r["count_sum"]) for r in alignment.with_counts(aligned).collect())
    found = [(i, *by_sets(own, t)) for i, t, *_ in rows]
    counts = Counter(p for *_, pairs in found for p in pairs)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    assert got == sorted((str(i), as_text(g) + ";" * bool(g), len(a), len(b), len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p)) for i, a, b, g, p in found)
    assert alignment.align(docs.where("false")).count() == 0
    assert alignment.with_counts(aligned.where("false")).count() == 0


def test_query_derives_digests(spark, own):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = alignment.op12_cross_tokenizer(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows[::7]:
        _, _, groups, pairs = by_sets(own, texts[r["doc_id"]])
        assert r["groups_sha256"] == (hashlib.sha256(as_text(groups).encode()).hexdigest() if groups else "")
        assert r["n_groups"] == len(groups) and r["n_links"] == len(pairs) <= r["count_sum"]
