"""Whitening and hard negatives against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest

from pressroom.llm import hard_negatives, whitening

from .helpers import SF

SHAPE = "vec_id long, embedding array<float>, label int, row string, x int, part string, `key` long"


def table(spark, rows, where):
    spark.createDataFrame([(*r, "r", 1, "p", 2) for r in rows], SHAPE).write.mode("overwrite").parquet(f"{where}/embeddings.parquet")
    return str(where)


def odd(n=300, d=6, seed=1):
    """Hot vectors, ties, nulls in every column, non-finite entries."""
    rng = np.random.default_rng(seed)
    hot = rng.normal(size=d)
    rows = [(i * 4 - 60, hot.tolist() if i % 3 == 0 else (rng.normal(size=d) + 2 * (i % 4)).tolist(), i % 4) for i in range(n)]
    bad = [float("nan"), float("inf"), -float("inf"), None]
    rows += [(10_000 + i, [1.0] * (d - 1) + [b], 1) for i, b in enumerate(bad)]
    return [*rows, (None, rng.normal(size=d).tolist(), 1), (20_000, None, 1), (20_100, rng.normal(size=d).tolist(), None), (20_001, [], 1), (20_200, hot.tolist(), 2), (20_203, hot.tolist(), 2)]


def quantised(rows):
    return [(v, tuple(math.floor(256 * float(np.float32(c))) for c in e), label) for v, e, label in rows if e and all(c is not None and math.isfinite(c) for c in e)]


def check_whitening(got, rows):
    x = quantised(rows)
    u = np.array(sorted({r[1] for r in x}))
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, min(4, u.shape[1]) + 1))
    assert len(got) == len(by) * len(x)
    for k, rs in by.items():
        mine = {}
        for r in rs:
            mine.setdefault(r.vec_id, r)
            assert r.n == n and abs(r.explained / (e[k - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
        sign = None
        for vec, xs, _ in x:
            r = mine[vec]
            assert r.deviation == sum((n * a - int(b)) ** 2 for a, b in zip(xs, s, strict=True))
            want = (np.array(xs) - s / n) @ v[:, k - 1] / np.sqrt(e[k - 1])
            sign = sign or (1 if want * r.whitened >= 0 else -1) if abs(want) > 1e-6 else sign
            assert abs(r.whitened - (sign or 1) * want) < 1e-6


def test_whitening_on_odd_rows(spark, tmp_path):
    rows = odd()
    check_whitening(whitening.op12_whitening(spark, table(spark, rows, tmp_path)).collect(), rows)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(whitening.op12_whitening(spark, SF).collect(), rows)


def test_merged_is_the_whole():
    """Any tree of merges has the spectrum of all rows, though there are fewer rows than dimensions in each."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(70, 12)) * rng.uniform(1, 3000, 12) + 10**6).astype(np.int64)
    parts = [whitening.summary(p) for p in np.array_split(x, 9)]
    while len(parts) > 1:
        i = rng.integers(len(parts) - 1)
        parts[i : i + 2] = [whitening.merged(parts[i], parts[i + 1])]
    whole = whitening.summary(x)
    assert parts[0].n == 70 and (parts[0].sums == x.sum(0)).all()
    assert np.allclose(parts[0].s, whole.s, rtol=1e-9) and np.allclose(np.abs((parts[0].vt * whole.vt).sum(1)), 1, atol=1e-8)


def test_many_partitions_merge_in_rounds(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, size=(900, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40)
    model = whitening.fit(df)
    c = x - x.mean(0)
    assert model.n == 900 and np.allclose(model.eigenvalues, np.sort(np.linalg.eigvalsh(c.T @ c / 900))[::-1], rtol=1e-10)
    assert whitening.identity_error(df, model) < 1e-10


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(1 << 33, np.array([1 << 55, -(1 << 50)]), np.ones(2), np.eye(2))
    x = np.array([[1 << 30, -5]])
    assert model.deviations(x) == [sum((model.n * int(a) - int(b)) ** 2 for a, b in zip(x[0], model.sums, strict=True))]


def test_whitening_of_little(spark, tmp_path):
    assert whitening.op12_whitening(spark, table(spark, [], tmp_path)).count() == 0
    assert whitening.op12_whitening(spark, table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], tmp_path)).count() == 0
    flat = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 4.0, 3.0], 1), (3, [1.0, 4.0, 3.0], 1)]  # one dimension has all the variance
    got = whitening.op12_whitening(spark, table(spark, flat, tmp_path)).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1), (3, 1)} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)
    with pytest.raises(Exception, match="differ in length"):
        whitening.op12_whitening(spark, table(spark, [(1, [1.0], 1), (2, [1.0, 4.0], 1)], tmp_path)).collect()


def brute_negatives(rows, every=100):
    x = [(v, q, (label + 1) % 10 if v % 7 == 0 else label) for v, q, label in quantised([r for r in rows if r[0] is not None and r[2] is not None])]
    out = set()
    for a, qa, la in x:
        if a % every:
            continue
        scored = sorted((-int(np.dot(qa, q)), v, label) for v, q, label in x)
        for ps, p, _ in [t for t in scored if t[2] == la and t[1] != a][:5]:
            fits = [t for t in scored if t[2] != la and 30 * -ps <= 100 * -t[0] <= 90 * -ps][:10]
            out |= {(a, p, k + 1, v, -ps, -s) for k, (s, v, _) in enumerate(fits)}
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_negatives_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TREE", 64)  # in the driver only: trees are also cut by partitions
    rows = odd(n=700)
    got = [tuple(r[c] for c in COLUMNS) for r in hard_negatives.op13_hard_negatives(spark, table(spark, rows, tmp_path)).collect()]
    want = brute_negatives(rows)
    assert len(want) > 100 and len(got) == len(want) and set(got) == want


def test_negatives_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {tuple(r[c] for c in COLUMNS) for r in hard_negatives.op13_hard_negatives(spark, SF).collect()}
    assert got == brute_negatives(rows)


def test_blocks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "SENT", 1)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist(), int(rng.integers(3))) for i in range(240)]
    df = spark.createDataFrame([(v, label if v % 7 else (label + 1) % 10, list(q)) for v, q, label in quantised(rows)], "id long, label long, x array<long>")
    got = {tuple(r[c] for c in COLUMNS) for r in hard_negatives.mine(df, every=10).collect()}
    assert got == brute_negatives(rows, every=10)


def test_negatives_of_little(spark, tmp_path):
    assert hard_negatives.op13_hard_negatives(spark, table(spark, [], tmp_path)).count() == 0
    assert hard_negatives.op13_hard_negatives(spark, table(spark, [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 2)], tmp_path)).count() == 0  # no positive


def test_tree_search_is_exact_and_prunes():
    rng = np.random.default_rng(7)
    centres = rng.integers(-900, 900, size=(12, 8))
    x = np.repeat(centres, 60, axis=0) + rng.integers(-20, 20, size=(720, 8))
    x[::5] = x[0]  # equal rows
    ids, labels = rng.permutation(720).astype(np.int64), rng.integers(0, 3, 720)
    tree = hard_negatives.grow(ids, labels, x, leaf=16)
    assert sorted(tree.ids) == sorted(ids)
    for (b, e, *_), c, r in zip(tree.nodes, tree.centres, tree.radii, strict=True):
        assert (np.sqrt(((tree.x[b:e] - c) ** 2).sum(1)) <= r + 1e-9).all()
    pick = rng.choice(720, 40, replace=False)
    who = np.arange(40)
    for same in (True, False):
        low = np.full(40, -np.inf) if same else rng.integers(-10**6, 10**6, 40).astype(float)
        high = low + 10**6 if not same else np.full(40, np.inf)
        anchors, best = hard_negatives.Anchors(ids[pick], labels[pick], x[pick], who, low, high), hard_negatives.Best(40, 4)
        for part in np.array_split(np.arange(720), 3):  # one tree after the other
            hard_negatives.search(hard_negatives.grow(ids[part], labels[part], x[part], leaf=16), anchors, same, best)
        q, found, score = best.rows()
        for i, p in enumerate(pick):
            s = x @ x[p]
            fits = [(-int(s[j]), int(ids[j])) for j in range(720) if (labels[j] == labels[p]) == same and low[i] <= s[j] <= high[i] and (not same or ids[j] != ids[p])]
            assert [(-int(a), int(b)) for a, b in zip(score[q == i], found[q == i], strict=True)] == sorted(fits)[:4]
