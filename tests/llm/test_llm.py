"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and
columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("flowledger.llm")
from flowledger.llm import graph, labelled, lm, maxscore, packing, pieces, quality, sharding, simhash, substring, tokenfile, tokens, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeé ñ".replace(" ", "")) for _ in range(draw.randrange(1, 6)))
    passage = [word() for _ in range(60)]
    out = [" ".join(word() for _ in range(draw.randrange(0, 80))) for _ in range(40)]
    out += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(draw.randrange(20))]) for _ in range(6)]
    out += [out[3], out[3], out[41], None, "", " \n\t ", "One", "x " * 500, "a\nb\na\n\n \na", "long " + "y" * 5000 + " end " + " ".join(passage), "### | $$ % & *", "tab\tand\x0bvertical\xa0nbsp\x85nel"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(4, rows[4][1]), (4, "another text under a known id"), (None, rows[5][1]), (None, None)]
    # further columns have names that operators use themselves
    own = spark.createDataFrame([(i, t, "src", 1, 2, [3]) for i, t in rows], "doc_id long, text string, source string, start int, removal int, words array<int>")
    return own.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def words(text):
    return WORD.findall(text or "")


# ---------------------------------------------------------------- op1, op2: tokens


@cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def whole_ids(text):
    return [*whole_tokenizer().encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def test_word_tokenizer_equals_whole_texts():
    own, plain = tokens.WordTokenizer(tokens.tokenizer_path()), whole_tokenizer()
    own.known.limit = 40  # so that words are forgotten and learned again
    odd = ["it's I'LL don'T 'sx", "ΣΑΣ İstanbul ǅ ﬁ", "a<|endoftext|>b <|startoftext|>", "é ́x ｅ", "12 3a4 ½ Ⅷ", "ªº µ ß ẞ ÷×", "日本語 テキスト", "👍🏽 x​y", "\x00\x01 \x7f \x80", "ÀÉÎ$$$ ñ&&&"]
    for batch in (texts(), odd, texts(), odd):
        ids, starts = own.encode([(t or "").encode() for t in batch])
        for k, t in enumerate(batch):
            assert ids[starts[k] : starts[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_packing_covers_every_id_once(docs, empty):
    got = packing.pack(docs, length=64, windows=4).collect()
    pieces_of, windows = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], np.uint32).tolist()
        assert len(ids) == r["length"]
        pieces_of.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], len(ids)))
    want = {}
    for doc_id, text in rows_of(docs):
        ids = whole_ids(text)
        want.setdefault((doc_id, len(ids)), []).append(ids)
    for key, wanted in want.items():
        held = sorted(sum((x for _, x in pieces_of.pop(key)), []))
        assert held == sorted(sum(wanted, []))
    assert not pieces_of
    for spans in windows.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 64
    total = sum(r["length"] for r in got)
    assert total / (64 * len(windows)) > 0.9
    assert packing.pack(empty).count() == 0


def test_packer_best_fit_and_fullest():
    p = packing.Packer(0, 10, 2)
    ids = lambda n: np.zeros(n, np.uint32)
    p.add(1, 0, 6, ids(6))  # window 0, room 4
    p.add(2, 0, 7, ids(7))  # window 1, room 3
    p.add(3, 0, 3, ids(3))  # fits window 1 exactly
    assert [(r[0], r[4]) for r in p.rows] == [(2, 1), (3, 1)]
    p.add(4, 0, 8, ids(8))  # window 2, room 2
    p.add(5, 0, 9, ids(9))  # no room: window 2, the fullest, goes
    assert [(r[0], r[4]) for r in p.rows[2:]] == [(4, 2)]


@pytest.mark.parametrize("high", [0, 1, 3, 255, 256, 5000, 65535, 65536, 2**31, 2**32 - 1])
def test_token_file_round_trip(high):
    draw = np.random.default_rng(high)
    for n in (0, 1, 127, 128, 129, 3000):
        x = np.where(draw.random(n) < 0.08, draw.integers(0, high, n, endpoint=True), draw.integers(0, max(1, high // 50), n, endpoint=True)).astype(np.uint32)
        sizes = np.diff(np.sort(np.concatenate([[0, n], draw.integers(0, n + 1, 5)])))
        f = tokenfile.TokenFile(tokenfile.encode_file(x, sizes))
        assert (f.ids() == x).all() and f.sizes.tolist() == sizes.tolist()
        assert (f.ids(n // 3, n // 2) == x[n // 3 : n // 2]).all()
    with pytest.raises(ValueError):
        tokenfile.TokenFile(b"x" * 64)


def test_token_files_in_order(spark, docs, empty, tmp_path):
    folder = str(tmp_path / "files")
    tokenfile.write_token_files(docs, folder, file_ids=300)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in tokenfile.read_token_files(spark, folder).collect()), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)
    start = 0
    for r in got:
        assert r[2] == start
        start += r[3]
    want = sorted((i is None, i or 0, len(x := whole_ids(t)), zlib.crc32(np.array(x, np.uint32).tobytes())) for i, t in rows_of(docs))
    assert sorted((r[0], r[1], r[3], r[4]) for r in got) == want
    tokenfile.write_token_files(empty, str(tmp_path / "none"))
    assert tokenfile.read_token_files(spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- op3: quality


def counters(text):
    w, lines, seen = words(text), [], set()
    dup = 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for own in at.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counters(docs, empty):
    model = quality.fit_trees(np.empty((0, len(quality.STATISTICS))), np.empty(0), list(quality.STATISTICS.values()))
    got = sorted(tuple(r)[1:7] for r in quality.score_quality(docs, model).collect())
    want = sorted((*(c := counters(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for _, t in rows_of(docs))
    assert got == want
    assert quality.score_quality(empty, model).count() == 0


def test_trees_are_monotonic_and_score_like_a_walk():
    draw = np.random.default_rng(1)
    x = draw.random((600, 3))
    y = ((x[:, 0] + 0.3 * draw.random(600) < 0.6) | (x[:, 1] > 0.8)).astype(float)
    model = quality.fit_trees(x, y, [-1, 0, 0], trees=25)
    assert ((model.probability(x) > 0.5) == (y > 0)).mean() > 0.9
    line = np.repeat(draw.random((40, 3)), 50, axis=0)
    line[:, 0] = np.tile(np.linspace(-1, 2, 50), 40)
    steps = np.diff(model.margin(line).reshape(40, 50), axis=1)
    assert (steps <= 1e-12).all()
    inner = model.feature.shape[1]
    for row in x[:20]:
        total = model.base
        for t in range(len(model.feature)):
            k = 0
            while k < inner:
                k = 2 * k + 1 + (row[model.feature[t, k]] > model.threshold[t, k])
            total += model.value[t, k - inner]
        assert total == pytest.approx(model.margin(row[None])[0])


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert sum((r["quality"] == 1) == r["kept"] for r in rows) / len(rows) > 0.95


# ---------------------------------------------------------------- op4: substrings


def without_repeats(rows, window):
    last = 2**63 - 1
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, last + 1), last if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (last if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 3, 13])
def test_repeated_windows(docs, window):
    found = substring.repeated_windows(docs, window)
    assert "source" in found.columns
    got = sorted(((r["doc_id"], r["removal"]["n_words"], r["removal"]["n_removed"], hashlib.sha256(r["removal"]["kept"].encode()).hexdigest()) for r in found.collect()), key=str)
    assert got == without_repeats(rows_of(docs), window)


def test_repeated_windows_spans_and_empty(spark, empty):
    assert substring.repeated_windows(empty).count() == 0
    hits = substring.rolling(np.arange(10, dtype=np.uint64), 3)
    assert substring.removal_spans([b"w"] * 10, np.empty(0, np.uint64), None, 3) == []
    assert substring.removal_spans(list("0123456789"), hits[[1, 2, 6]], lambda w: np.arange(10, dtype=np.uint64), 3) == [(1, 5), (6, 9)]


# ---------------------------------------------------------------- op5: SimHash


def fingerprint(text, width=3, seed=42):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, distance):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        own = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(own, default=None)
    return sorted(((d, prints[i], least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_classes(docs, empty):
    got = sorted(((r["doc_id"], r["words"][0] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == classes(rows_of(docs), 3)
    assert simhash.near_duplicates(empty).count() == 0


def test_majority_of_many():
    draw = np.random.default_rng(2)
    runs = [draw.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 2, 255, 256, 700)]
    got = simhash.majority_bits(np.concatenate(runs), np.cumsum([0, *map(len, runs)]))
    assert got.tolist() == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in r) > len(r)) for r in runs]


@pytest.mark.parametrize(("bits", "radius"), [(10, 2), (9, 3), (7, 3)])
def test_masks_cover_every_pair(bits, radius):
    from itertools import combinations

    masks = simhash.block_masks(list(range(bits)), radius)
    for n in range(radius + 1):
        for apart in combinations(range(bits), n):
            assert any(not any(m >> b & 1 for b in apart) for m in masks)


def test_links_survive_splitting(spark):
    """A dense group far over the limit is split by finer masks and loses no link."""
    draw = random.Random(3)
    base = draw.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(6))) for _ in range(300)} | {draw.getrandbits(64) for _ in range(50)})
    rows = [(i, simhash.signed(p)) for i, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(rows, "id long, w0 long"), 1, 3, 3, limit=8)
    got = {r["vertex"]: r["component"] for r in graph.connected_components(edges).collect()}
    a, b = zip(*((i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3), strict=True)
    want_a, want_b = graph.forest(np.array(a), np.array(b))
    want = dict(zip(want_a.tolist(), want_b.tolist(), strict=True))
    assert {k: v for k, v in got.items() if k != v} == want


@pytest.mark.parametrize("radius", [3, 4])
def test_finer_masks_keep_every_pair(radius):
    """Each pair that a mask joins is also joined by one of its finer masks, down to groups that are compared whole."""
    from itertools import combinations

    for mask in simhash.block_masks(list(range(32)), radius):
        level = [mask]
        while level:
            m = level.pop()
            finer = [x for x in simhash.finer(0, 0, m, 2, radius) if x != m]
            free = [b for b in range(32) if not m >> b & 1]
            if not finer:
                assert len(free) <= 4 * (radius + 1)
                continue
            assert all(any(not any(x >> b & 1 for b in apart) for x in finer) for apart in combinations(free, min(radius, len(free))))
            level.append(finer[0])


def test_components_of_chains_stars_and_a_hot_vertex(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 900)] + [(3000, 3001), (3001, 3000), (5, 5)]
    got = {r["vertex"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(900)} | {3000: 3000, 3001: 3000}


def test_one_of_each_stays(docs, empty):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    held = [r["text"] for r in kept.collect()]
    assert len(held) == len(set(x or "" for x in held if words(x))) + sum(not words(x) for x in held)
    assert sum(not words(x) for x in held) == 1
    assert {x for x in held if words(x)} >= {t for _, t in rows_of(docs) if t and len(words(t)) > 60 and "y" * 100 in t}
    assert simhash.keep_one_of_each(empty).count() == 0


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def test_one_of_each_by_exact_shingle_similarity(spark):
    """Near copies around similarity 0.8, a chain, a common line, and hubs that don't reach every member of a group."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    line, texts = " ".join(word() for _ in range(20)), []
    for k in range(12):
        base = [word() for _ in range(draw.choice([4, 9, 60, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(14):
            own = base if draw.random() < 0.7 else texts[-1].split()
            own = [word() if draw.random() < draw.choice([0.01, 0.02, 0.025, 0.03, 0.05]) else w for w in own]
            texts.append(" ".join(own) + (" " + line if k % 3 == 0 else ""))
    texts += [f"{word()} {line}" for _ in range(20)] + ["", None, " "]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()) == sorted({find(i) for i in range(len(texts))})


# ---------------------------------------------------------------- op6: top k


def test_top_k(spark):
    draw = random.Random(4)
    rows = [(i, [float(draw.randrange(-4, 5)) for _ in range(6)], 0) for i in range(120)] + [(7, [1.0] * 6, 0), (200, [0.5, None] + [0.0] * 4, 0), (201, None, 0), (202, [float("nan")] * 6, 0), (203, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (204, [1.0] * 3, 0), (208, [], 0), (256, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    vectors = maxscore.quantized(table)
    got = sorted(tuple(r) for r in maxscore.top_k(vectors.where("vec_id % 8 = 0"), vectors, 5).collect())
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 8 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    none = vectors.where("false")
    assert maxscore.top_k(none, vectors).count() == 0 and maxscore.top_k(vectors, none).count() == 0


def test_max_score_skips_and_stays_exact():
    draw = np.random.default_rng(6)
    vectors = np.floor(draw.normal(0, 40, (5000, 32)) * np.linspace(3, 0.05, 32))
    queries, ids, counts = vectors[:20], np.arange(5000), {}
    for i, (s, found) in enumerate(maxscore.search_shard(queries, ids[:20], vectors, ids, 5, counts)):
        scores = vectors @ queries[i]
        scores[i] = -np.inf
        order = np.lexsort((ids, -scores))[:5]
        assert found.tolist() == order.tolist() and s.tolist() == scores[order].tolist()
    assert counts["looked"] < 0.8 * counts["all"]
    huge = np.array([[2.0**40, 3.0], [2.0**40, -5.0], [1.0, 1.0]])
    assert [x[1].tolist() for x in maxscore.search_shard(huge[:1], np.array([0]), huge, np.arange(3), 2)] == [[1, 2]]


# ---------------------------------------------------------------- op7: language model


def class_of(vocabulary, word):
    """The class of a word, byte by byte."""
    if word in vocabulary:
        return 1 + lm.SHAPES + vocabulary.index(word)
    upper, lower, digit = set(range(65, 91)), {*range(97, 123), *range(128, 256)}, set(range(48, 58))
    chars = set(word)
    kind = 3 if chars & digit else 0 if chars <= lower else 2 if chars <= upper else 1 if word[0] in upper and set(word[1:]) <= lower else 4
    return 1 + 3 * kind + (len(word) > 4) + (len(word) > 8)


def test_shape_classes():
    odd = [b"a", b"A", b"Ab", b"AB", b"aB", b"abcde", b"Abcde", b"ABCDEFGHI", b"a1", b"#", b"a-b", "éé".encode(), "Éa".encode(), b"x" * 9, b"the"]
    assert lm.WordClasses([b"the"]).of(pa.array(odd, pa.binary())).tolist() == [class_of([b"the"], w) for w in odd]
    assert lm.WordClasses([]).of(pa.array([], pa.string())).tolist() == []


def likelihoods_by_hand(scored, trained, network):
    """(doc_id, words, log-likelihood) of each text: the network's classes, and each word's share of its class."""
    counts = Counter(w.encode() for t in trained for w in words(t))
    of = lambda w: class_of(network.words, w)
    seen, kinds = Counter(), Counter()
    for w, n in counts.items():
        seen[of(w)] += n
        kinds[of(w)] += 1
    for i, t in scored:
        own = [w.encode() for w in words(t)]
        ids = [0, *map(of, own), 0]
        total = sum(network.log_probabilities(np.array([ids[k - 1] * lm.CLASSES + ids[k + 1]]))[0, ids[k]] for k in range(1, len(ids) - 1))
        for w in own:
            if of(w) <= lm.SHAPES:
                total += np.log((counts.get(w) or kinds[of(w)] + 1) / (seen[of(w)] + kinds[of(w)] + 1))
        yield i, len(own), float(total)


def test_likelihood_by_hand(spark, docs, empty):
    model, losses = lm.train(docs, rounds=6)
    assert losses[-1] < losses[0]
    strange = spark.createDataFrame([(1, "zzzz Qq12 zzzz neverseen"), (None, None), (2, "")], "doc_id int, text string")
    for some in (docs, strange):
        got = sorted(((r["doc_id"], r["n_words"], r["log_likelihood"], r["mean_log_prob"]) for r in lm.score_likelihood(some, model).collect()), key=lambda r: (str(r[0]), r[1], r[2]))
        want = sorted(likelihoods_by_hand(rows_of(some), [t for _, t in rows_of(docs)], model.network), key=lambda r: (str(r[0]), r[1], r[2]))
        for (i, n, x, mean), (j, m, y) in zip(got, want, strict=True):
            assert (i, n) == (j, m) and abs(x - y) < 0.01 + 1e-4 * abs(y)
            assert mean is None if n == 0 else abs(mean - y / n) < 0.01
    nothing, _ = lm.train(empty, rounds=2)
    assert lm.score_likelihood(empty, nothing).count() == 0
    assert lm.score_likelihood(docs, nothing).count() == docs.count()


def test_a_rare_word_scores_above_a_word_of_the_same_shape_that_the_corpus_lacks(spark):
    rows = [(i, f"the pump moves water through a valve near brook{'abcdefgh'[i % 8]} and back") for i in range(400)]
    corpus = spark.createDataFrame(rows + [(1000 + i, f"extra{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(300)], "doc_id long, text string")
    model, _ = lm.train(corpus, rounds=4)
    model.network.words = model.network.words[:6]  # so that the names are rare ones of a shape
    model.seen, model.kinds = lm.class_sizes(model.counts, model.network.words)
    asked = spark.createDataFrame([(1, "the brooka and"), (2, "the qxzvvk and")], "doc_id long, text string")
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.score_likelihood(asked, model).collect()}
    share = lambda n: (400 // 8) / (model.kinds[class_of(model.network.words, b"brooka")] + 1) if n else 1.0
    assert got[1] != got[2]
    assert got[1] - got[2] == pytest.approx(np.log(share(True)), abs=1e-3)


def test_many_long_words_and_one_very_long_one(spark):
    long = [(i, " ".join(f"{i:04d}{k:04d}" + "q" * 9000 for k in range(20))) for i in range(30)] + [(99, "w" * 3_000_000)]
    some = spark.createDataFrame(long, "doc_id long, text string").repartition(2)
    model, _ = lm.train(some, rounds=2)
    got = {r["doc_id"]: (r["n_words"], r["log_likelihood"]) for r in lm.score_likelihood(some, model).collect()}
    assert len(got) == 31 and got[99][0] == 1 and all(n == 20 and x < 0 for i, (n, x) in got.items() if i != 99)


def test_gradient_is_the_slope():
    draw = np.random.default_rng(8)
    network = lm.WindowNetwork([], *(draw.normal(0, 0.3, s) for s in ((lm.CLASSES, 4), (lm.CLASSES, 4), (4,), (4, lm.CLASSES), (lm.CLASSES,))))
    codes = np.unique(draw.integers(0, lm.CLASSES**2, 50) * lm.CLASSES + draw.integers(1, lm.CLASSES, 50)).astype(np.int32)
    counts = draw.integers(1, 9, len(codes))
    _, sums = network.gradient(codes, counts)
    for x, g in zip(network.parameters(), sums, strict=True):
        k = int(np.argmax(np.abs(g)))
        x.ravel()[k] += 1e-5
        up = network.gradient(codes, counts)[0]
        x.ravel()[k] -= 2e-5
        down = network.gradient(codes, counts)[0]
        x.ravel()[k] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g.ravel()[k], rel=1e-4)


def test_window_counts(docs):
    found = {}
    for r in lm.window_counts(docs, [b"a", b"b"]).collect():
        for code, n in zip(np.frombuffer(r["codes"], np.int32).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True):
            assert code not in found
            found[code] = n
    want = {}
    for _, t in rows_of(docs):
        ids = [0, *(class_of([b"a", b"b"], w.encode()) for w in words(t)), 0]
        for k in range(1, len(ids) - 1):
            code = (ids[k - 1] * lm.CLASSES + ids[k + 1]) * lm.CLASSES + ids[k]
            want[code] = want.get(code, 0) + 1
    assert found == want


# ---------------------------------------------------------------- op8: toxicity


def test_ordinal_model_learns_grades():
    draw = np.random.default_rng(9)
    rows, grades = [], []
    for _ in range(800):
        grade = int(draw.choice([0, 0, 0, 0, 1, 2]))
        rows.append(np.unique(np.concatenate([draw.integers(100, 400, 30), [[], [7], [7, 8, 9]][grade]]).astype(np.uint64)))
        grades.append(grade)
    model = toxicity.fit_ordinal(rows, np.array(grades), steps=600)
    assert (np.diff(model.cuts) >= 0).all()
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    signal = np.array([sum(weight.get(int(x), 0) for x in r) for r in rows])
    above = model.above(signal)
    assert ((above[:, 0] > 0.5) == (np.array(grades) > 0)).mean() > 0.97
    assert (np.diff(above, axis=1) <= 0).all()
    severity = above.sum(axis=1)
    assert severity[np.array(grades) == 2].mean() > severity[np.array(grades) == 1].mean() + 0.3
    assert toxicity.fit_ordinal([], np.empty(0, int)).above(np.zeros(1))[0, 0] < 1e-6


def test_toxicity_columns(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, int(i in (1, 3, 7)), "x") for i in range(20)] + [(None, 1, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["severity"] <= len(model.cuts) for r in rows)
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert toxicity.keep_clean(docs, labels.where("false")).count() == docs.count() and not len(none.words)


def test_toxicity_scores_by_hand(spark, docs):
    """Each document's score from its words one by one, also of a text that is one very long word."""
    labels = spark.createDataFrame([(i, int(i % 4 > 1), int(i % 5 < 2)) for i in range(46)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert len(model.words)
    own = rows_of(docs) + [(900, "Abcd" * 700_000), (901, "a-b_c.d!e\x85f\xa0g"), (902, "ABCDEFGH" + "x" * 50), (903, None)]
    more = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["severity"], r["p_toxic"], r["toxic"]) for r in toxicity.score_toxicity(more, model).collect()), key=str)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    want = []
    for i, text in own:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = {w.encode()[:k] for w in re.split("[\x09-\x0D\x20!-/:-@\\[-`{-~]+", lower) if w for k in (4, 6, 8)}
        signal = sum(weight.get(xxhash.xxh64_intdigest(x), 0.0) for x in found)
        above = [1 / (1 + np.exp(min(40, max(-40, cut - signal)))) for cut in model.cuts]
        want.append((i, sum(above), above[0], bool(above[0] >= 0.5)))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[0] == w[0] and g[1:3] == pytest.approx(w[1:3], abs=1e-9) and g[3] == w[3]


def test_long_words_of_other_operators(spark):
    """One very long word beside plain texts."""
    own = [(1, "w" * 2_000_000), (2, "w" * 2_000_000), (3, "a b c"), (4, "x" * 300_000 + " " + "y" * 300_000)]
    some = spark.createDataFrame(own, "doc_id long, text string").repartition(2)
    removed = {r["doc_id"]: (r["removal"]["n_words"], r["removal"]["n_removed"]) for r in substring.repeated_windows(some).collect()}
    assert removed == {1: (1, 0), 2: (1, 0), 3: (3, 0), 4: (2, 0)}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    scored = {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in quality.score_quality(some, quality.fit_quality(some, labels)).collect()}
    assert scored[1] == (1, 2_000_000) and scored[4] == (2, 600_000)


def test_toxic_documents_are_found(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 5 <> 0"))
    rows = toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    toxic, clean = [r["found"] for r in rows if r["toxic"]], [r["found"] for r in rows if not r["toxic"]]
    assert sum(toxic) / len(toxic) > 0.75 and sum(clean) / len(clean) < 0.02


def test_labelled_sample_is_bounded(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 5), (None, 1), (9, None)], "doc_id long, quality int")
    rows = labelled.labelled_sample(docs, labels, F.col("quality"), F.length("text"), 10).collect()
    assert len(rows) == 10 == len({r["doc_id"] for r in rows})


# ---------------------------------------------------------------- op9: sharding


def shards(rows, limit):
    sized = [(i, n, int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)) for i, n in rows]
    out = []
    for i, n, h in sized:
        depth = 0
        while depth < 60:
            own = [(a, m) for a, m, g in sized if g >> (60 - depth) == h >> (60 - depth)]
            if sum(m for _, m in own) <= limit or len(own) == 1:
                break
            depth += 1
        out.append((i, n, format(h >> (60 - depth), "b").zfill(depth) if depth else "", sum(m for _, m in own), len(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1, 150, 2000, 10**9])
def test_shards(spark, docs, limit):
    rows = [(i, len((t or "").encode())) for i, t in {i: t for i, t in rows_of(docs) if i is not None}.items()]
    table = spark.createDataFrame([(i, n, "x", 0) for i, n in rows], "doc_id long, n long, shard string, _size int").repartition(3)
    got = sorted(((r["doc_id"], r["n"], r["shard"], r["shard_bytes"], r["shard_rows"]) for r in sharding.assign_shards(table, "doc_id", "n", limit).collect()), key=str)
    assert got == shards(rows, limit)


def test_shards_tell_equal_keys_apart(spark):
    table = spark.createDataFrame([(1, 10)] * 300 + [(None, 10)] * 20 + [(2, None)] * 3, "doc_id long, n long").repartition(4)
    got = sharding.assign_shards(table, "doc_id", "n", 100)
    assert got.count() == 323
    sizes = got.groupBy("shard").agg({"n": "sum", "shard_bytes": "max", "*": "count"}).collect()
    assert all((r["sum(n)"] or 0) <= 100 and (r["sum(n)"] or 0) == r["max(shard_bytes)"] for r in sizes)
    assert sharding.assign_shards(table.where("false"), "doc_id", "n", 100).count() == 0


def test_shards_are_written(spark, docs, tmp_path):
    sharding.write_shards(docs.drop("start"), str(tmp_path / "s"), 2000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# ---------------------------------------------------------------- op10: SentencePiece


def test_pieces_equal_the_library():
    import sentencepiece

    own, lib = pieces.PieceModel(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    own.known.limit = 50
    draw = random.Random(10)
    odd = ["", " a  b", "a\nb", "  ", "日本 x\t y", "a▁b", "▁▁日本語テキスト" * 20, "ﬁ Ａ\x00b\x01", " \n ", "x" * 300, "aaaa bbbb" * 30, "👍🏽 ok", "the    quick     brown", "\r\n\r\n"]
    odd += ["".join(draw.choice("ab  ▁\n\tétheTh日👍.,&$#1 2") for _ in range(draw.randrange(150))) for _ in range(500)]
    for batch in (odd, [t or "" for t in texts()], odd):
        ids, starts = own.encode([t.encode() for t in batch])
        for k, t in enumerate(batch):
            mine = ids[starts[k] : starts[k + 1]]
            assert mine.tolist() == lib.encode(t), t
            assert own.decode(mine) == lib.decode(mine.tolist()), t


def test_suffix_array_ranges():
    codes = np.frombuffer("banana\0bandana".encode("utf-32-le"), np.uint32)
    order = pieces.suffix_array(codes, 16)
    tails = [codes[i:].tolist() for i in order]
    assert tails == sorted(tails)
    names = ["an", "ana", "b", "nd", "zz", "bananas"]
    table = np.zeros((len(names), 7), np.uint32)
    for i, n in enumerate(names):
        table[i, : len(n)] = [ord(c) for c in n]
    low, high = pieces.piece_ranges(codes, order, table, np.array([len(n) for n in names]))
    text = "banana\0bandana"
    for i, n in enumerate(names):
        assert sorted(order[low[i] : high[i]].tolist()) == [k for k in range(len(text)) if text.startswith(n, k)]


def test_piece_columns(docs, empty):
    back = pieces.decode(pieces.encode(docs)).collect()
    assert sorted((r["text"] for r in back)) == sorted((t or "").replace("▁", " ") for _, t in rows_of(docs))
    assert pieces.decode(pieces.encode(empty)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "simhash_near_dedup", "substring_dedup", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, SF)
        if name != "packing":
            assert after.columns == docs.columns
        rows = after.collect()
        ids = [r["doc_id"] for r in rows]
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect() if r["toxic"]}
            assert set(ids) == set(before) - bad
        elif name == "quality_rules":
            good = {r["doc_id"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect() if r["kept"]}
            assert set(ids) == good
        elif name == "simhash_near_dedup":
            sets = {i: shingle_set(t) for i, t in before.items()}
            near = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            assert not any(near(i, j) for i in ids for j in ids if i < j)
            assert all(any(near(i, j) for j in before if j != i) for i in set(before) - set(ids))
        elif name == "substring_dedup":
            want = {i: (n, digest) for i, _, n, digest in without_repeats(list(before.items()), 13)}
            for r in rows:
                n, digest = want[r["doc_id"]]
                assert r["text"] == before[r["doc_id"]] if n == 0 else hashlib.sha256(r["text"].encode()).hexdigest() == digest
        else:
            assert sum(r["length"] for r in rows) == sum(len(whole_ids(t)) for t in before.values())
        docs = spark.createDataFrame(rows, after.schema) if name != "packing" else None
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
