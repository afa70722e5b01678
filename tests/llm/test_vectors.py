"""Joins and searches over vectors against brute force, and on nulls, ties, repeats, empty tables and other columns."""

import math

import numpy as np
import pytest

pytest.importorskip("flowledger.llm")
from flowledger.llm import grid, gridjoin, maxscore, negatives  # noqa: E402

# ---------------------------------------------------------------- op11: near vectors


def clusters(seed=1):
    """(vec_id, label, vector): spread ones, close groups, equal ones, chains, and all that must not be compared."""
    draw = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    rows, n = [], 0

    def add(label, v):
        nonlocal n
        rows.append((n, label, None if v is None else [float(x) for x in v]))
        n += 1

    for _ in range(900):
        add(int(draw.integers(3)), draw.normal(size=12))
    for _ in range(6):
        centre, label = unit(draw.normal(size=12)), int(draw.integers(3))
        for _ in range(int(draw.integers(2, 40))):
            add(label, draw.uniform(0.1, 9) * unit(centre + draw.normal(0, 0.05, 12)))
    same = draw.normal(size=12)
    for k in range(260):
        add(1 if k % 2 else 2, same)
    add(None, same)
    a, b = unit(draw.normal(size=12)), unit(draw.normal(size=12))
    for t in np.linspace(0, 1, 15):
        add(0, (1 - t) * a + t * b)
    add(1, 1e300 * same)
    add(1, 1e-300 * same)
    add(2, -same)
    for odd in (None, [], [0.0] * 12, [math.nan] * 12, [math.inf] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [0.0, -0.0]):
        add(1, odd)
    return rows


def linked(rows, threshold):
    ok = {i: np.array(v) for i, label, v in rows if label is not None and v and all(map(math.isfinite, v)) and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    label = {i: x for i, x, _ in rows}
    near = {i: [j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and unit[i] @ unit[j] >= threshold] for i in ok}
    out = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen))
    return out


VECTORS = "vec_id long, label int, embedding array<double>, v string, n_links string, grp int, a int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], VECTORS)


@pytest.mark.parametrize("threshold", [0.98, 0.8])
def test_near_vectors_equal_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(gridjoin, "BLOCK", 64)  # so that the tree of blocks has levels
    rows = clusters()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in gridjoin.near_vectors(table(spark, rows), threshold).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in linked(rows, threshold).items()}


def test_near_vectors_of_odd_tables(spark):
    assert gridjoin.near_vectors(table(spark, [])).count() == 0
    rows = [(None, 1, [1.0, 0.0]), (4, 1, [1.0, 0.0]), (3, 1, [2.0, 0.0]), (3, 2, [1.0, 0.0]), (9, 1, [0.0, 1.0]), (9, 1, [0.0, 1.0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in gridjoin.near_vectors(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (4, 1, 3, False), (3, 1, 3, True), (3, 0, 3, True), (9, 1, 9, True), (9, 1, 9, True)], key=str)
    whole = gridjoin.near_vectors(table(spark, rows), group=None).where("vec_id = 4").first()
    assert (whole["n_links"], whole["component_id"]) == (2, 3)


def test_intervals_that_are_far_are_skipped():
    draw = np.random.default_rng(3)
    axes = np.linalg.qr(draw.normal(size=(16, 16)))[0][:, : gridjoin.AXES]
    x = np.concatenate([c + draw.normal(0, 0.02, (64, 16)) for c in np.eye(16)[:8]])
    looked = {}
    i, j = gridjoin.join_intervals(x, None, axes, 0.98, looked)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(w.tolist() for w in want), strict=True))
    assert looked["looked"] < len(x) ** 2 / 4


# ---------------------------------------------------------------- op6, op13: searches


def whole_numbers(n=700, dims=6, seed=4, most=9):
    draw = np.random.default_rng(seed)
    return [(i, int(draw.integers(3)), draw.integers(-most, most + 1, dims).astype(float).tolist()) for i in range(n)]


def mined(anchors, rows, n_positives, n_negatives, low, high):
    out = []
    for i, label, v in anchors:
        scored = sorted((-int(sum(int(x) * int(y) for x, y in zip(v, w, strict=True))), j, other) for j, other, w in rows if j != i and len(w) == len(v))
        positives = [(j, -s) for s, j, other in scored if other == label][:n_positives]
        for j, p in positives:
            fits = [(k, -s) for s, k, other in scored if other != label and low * p <= -100 * s <= high * p][:n_negatives]
            out += [(i, j, rank, k, p, s) for rank, (k, s) in enumerate(fits, 1)]
    return sorted(out)


INTEGERS = "vec_id long, label long, v array<double>, anchor int, down int, block int"


@pytest.mark.parametrize("most", [1, 9, 2**30])
def test_mined_negatives_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", 150)
    monkeypatch.setattr(negatives, "QUERIES", 10)
    rows = whole_numbers(most=most) + [(1000 + k, k % 2, [1.0, 2.0]) for k in range(9)]
    anchors = [r for r in rows if r[0] % 20 == 0]
    frame = lambda x: spark.createDataFrame([(*r, 1, 2, 3) for r in x], INTEGERS)
    got = negatives.mine(frame(anchors + [(None, 1, [1.0] * 6), (7, None, [1.0] * 6), (7, 1, None)]), frame(rows + [(None, 1, [1.0] * 6), (8, None, [1.0] * 6), (8, 1, None)]).repartition(3))
    assert sorted(map(tuple, got.collect())) == mined(anchors, rows, 5, 3, 50, 95)
    assert negatives.mine(frame([]), frame(rows)).count() == negatives.mine(frame(anchors), frame([])).count() == 0


def test_mined_negatives_of_repeated_rows(spark):
    frame = lambda x: spark.createDataFrame([(*r, 1, 2, 3) for r in x], INTEGERS)
    rows = [(1, 0, [10.0]), (2, 0, [10.0]), (3, 1, [9.0]), (3, 1, [9.0]), (4, 1, [5.0]), (5, 1, [4.0])]
    got = sorted(tuple(r) for r in negatives.mine(frame([rows[0], rows[0]]), frame(rows)).collect())
    assert got == sorted([(1, 2, 1, 3, 100, 90), (1, 2, 2, 3, 100, 90), (1, 2, 3, 4, 100, 50)] * 2)
    zero = [(1, 0, [0.0]), (2, 0, [5.0]), (7, 1, [3.0])]  # a score of 0 has a window of 0 alone
    assert [tuple(r) for r in negatives.mine(frame(zero[:1]), frame(zero)).collect()] == [(1, 2, 1, 7, 0, 0)]


def test_blocks_are_read_again_as_they_were_written(spark):
    """Which vectors share a block depends on the order of arrival, so every use of them must read one table."""
    rows = spark.createDataFrame([(i, 0, [float(i)] * 4) for i in range(5000)], "vec_id long, label long, v array<double>")
    shards = grid.blocks(rows, 512, 4, "shards")
    assert "FileScan" in shards._jdf.queryExecution().executedPlan().toString()
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in shards.collect()])
    assert sorted(ids.tolist()) == list(range(5000))
    assert max(len(r["ids"]) // 8 for r in shards.collect()) == 512
    assert maxscore.top_k(rows.where("vec_id = 7"), rows, 2).collect()[0]["vec_id"] == 4999
