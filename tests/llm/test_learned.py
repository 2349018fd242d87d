"""The operators that learn: held-out accuracy, formulas, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from pressroom.llm import docstats, fm, quality_rules
from pressroom.llm.quality_fm import fit_quality, op2_quality_fm
from pressroom.llm.toxicity import drop_toxic, fit_toxicity, fold, op4_toxicity

from .helpers import docs, frame, words

SF = "/root/testdata/sf0.01"


def _held_out(spark, score, label, held):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(held).select("doc_id", label)
    return score.join(labels, "doc_id").toPandas()


def test_quality_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = _held_out(spark, fm.score(d, fit_quality(d, labels)).select("row.doc_id", "score"), "quality", fold(5) == 0)
    assert ((out.score >= 0.3) == (out.quality == 1)).mean() > 0.95
    rules = quality_rules.judge(d, quality_rules.fit_rules(d, labels)).select("row.doc_id", "score", "kept", "base_failed")
    out = _held_out(spark, rules, "quality", fold(5) == 0)
    assert ((out.score >= 0.3) == (out.quality == 1)).mean() > 0.95
    assert not (out.kept & out.base_failed).any()


def test_toxicity_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = _held_out(spark, fm.score(d, fit_toxicity(d, labels)).select("row.doc_id", "score"), "toxic", fold(3) == 1)
    assert ((out.score >= 0.7) == (out.toxic == 1)).mean() > 0.9  # from 28 toxic rows


def test_pair_is_learned():
    """Two words that are harmful only together: an additive model can't tell, the pairwise term does."""
    rng = random.Random(5)
    texts = [" ".join([*words(rng, 20, 50), *(["insult"] if a else []), *(["group"] if b else [])]) for a in (0, 1) for b in (0, 1) for _ in range(150)]
    y = np.array([a & b for a in (0, 1) for b in (0, 1) for _ in range(150)])
    terms = fm.Terms()
    sets = [terms(fm.raw_features(t, False)[0]).tolist() for t in texts]
    share = lambda b, k: np.mean([b in s for s, a in zip(sets, y, strict=True) if a == k])
    keep = {b: k for k, b in enumerate(sorted(b for b in {b for s in sets for b in s} if abs(share(b, 1) - share(b, 0)) > 0.3))}
    m = fm.fit([np.array([keep[b] for b in s if b in keep], dtype=np.int64) for s in sets], np.zeros((len(texts), 0)), y, keep)
    s = m.scores(["insult group w1", "insult w1", "group w1", "w1"])
    assert s[0] > 0.7 > max(s[1:])


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = fm.Model(0.3, rng.normal(size=6), rng.normal(size=(6, 4)), {}, [], False)
    i = np.array([0, 2, 5])
    m.columns = lambda t: i
    pairs = sum(m.v[a] @ m.v[b] for k, a in enumerate(i) for b in i[k + 1 :])
    assert np.isclose(m.scores([""])[0], 1 / (1 + np.exp(-(0.3 + m.w[i].sum() + pairs))))


def test_sums_by_row_and_column():
    rng = np.random.default_rng(6)
    rows = [np.sort(rng.choice(9, rng.integers(0, 6), replace=False)) for _ in range(40)]
    x = np.zeros((40, 9))
    for k, r in enumerate(rows):
        x[k, r] = 1
    sparse, w, g = fm.Rows(rows, 9), rng.normal(size=(9, 3)), rng.normal(size=(40, 2))
    sparse.by_column()
    assert np.allclose(sparse.dot(w), x @ w) and np.allclose(sparse.back(g), x.T @ g)


def test_significant_buckets_are_all_kept(spark):
    """The buckets that executors keep are those of a plain count over the training rows, however many there are."""
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    train = {r.doc_id: r.quality for r in labels.where(fold(5) != 0).collect() if r.doc_id in text}
    terms, pos, neg = fm.Terms(), {}, {}
    for k, y in train.items():
        for b in terms(fm.raw_features(text[k], False)[0]).tolist():
            (pos if y else neg)[b] = (pos if y else neg).get(b, 0) + 1
    n1, n0 = sum(train.values()), len(train) - sum(train.values())
    want = set()
    for b in {*pos, *neg}:
        i, j = pos.get(b, 0), neg.get(b, 0)
        p = (i + j) / (n1 + n0)
        if i + j >= fm.LEAST and abs(i / n1 - j / n0) > fm.SIGNIFICANT * (max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)) ** 0.5:
            want.add(b)
    assert set(fit_quality(d, labels).keep) == want and want


def test_queries_score_by_double_loop(spark):
    """op2's and op4's scores against w0 + sum w + sum of all pairs, term by term and pair by pair, over every document."""
    small = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    for query, fitted, threshold, modulus, rest in ((op2_quality_fm, fit_quality, 0.3, 5, 0), (op4_toxicity, fit_toxicity, 0.7, 3, 1)):
        m = fitted(d, labels)
        got = {r.doc_id: r for r in query(spark, small).collect()}
        for r in d.collect():
            i = set()
            for w in (r.text or "").encode().split():
                low = w.decode().strip(".,;:!?\"'()[]").lower()
                for x in (b"" + low.encode(), b"^4" + low[:4].encode(), b"^5" + low[:5].encode()) if low else ():
                    if (b := zlib.crc32(x) >> 12) in m.keep:
                        i.add(m.keep[b])
            n = len(m.keep)
            for x, e in zip(docstats.ratios(r.text, docstats.counts(r.text)[0]) if m.stats else [], m.edges, strict=True):
                i.add(n + sum(x >= c for c in e))
                n += len(e) + 1
            i = sorted(i)
            y = m.w0 + sum(m.w[a] for a in i) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(i) for b in i[k + 1 :])
            want = 1 / (1 + math.exp(-min(max(y, -30), 30)))
            assert abs(got[r.doc_id].score - want) < 1e-9
            assert got[r.doc_id].predicted == (got[r.doc_id].score >= threshold)
            assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert len(got) == d.count()


def test_rules_query_counts_by_brute_force(spark):
    """op5's base columns over every document of the table."""
    small = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        x, want = got[r.doc_id], brute_counts(r.text)
        assert [x[k] for k in quality_rules.BASE] == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (x.kept and x.base_failed)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(5, 0, 1), (8, 1, 0), (7, 1, 0), (None, 1, 1), (3, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    d = frame(spark)
    for model in (fit_toxicity(d, labels), fit_quality(d, labels)):
        out = fm.score(d, model).collect()
        assert len(out) == d.count() and all(0 <= r.score <= 1 for r in out)
    assert fit_toxicity(d, labels.where("doc_id > 1000")).scores([None, "", "x"]).tolist() == [0.5] * 3
    assert drop_toxic(d, labels).columns == d.columns
    assert drop_toxic(frame(spark, []), labels).count() == 0
    out = quality_rules.judge(d, quality_rules.fit_rules(d, labels)).collect()
    assert len(out) == d.count() and all(r.base_failed and not r.kept for r in out if not (r["row"]["text"] or "").split())


def brute_counts(text):
    import re

    text = text or ""
    pat = r"[^\x20\x09-\x0D]+"
    w = re.findall(pat, text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(wins)
    cover = {i + k for i, x in enumerate(wins) if times[x] > 1 for k in range(5)}
    lines, dup = text.split("\n"), 0
    dup = sum(1 for i, x in enumerate(lines) if re.search(pat, x) and x in lines[:i])
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_base_counts():
    rng = random.Random(2)
    texts = [None, "", " \n ", "a b c d e a b c d e", "x\nx\n\n\nx y", "é # |  <>", "a a a a a a a"] + ["\n".join(" ".join(words(rng, rng.randrange(0, 9), 3)) for _ in range(6)) for _ in range(60)]
    for t in texts:
        c = docstats.counts(t)[0]
        assert [c[k] for k in quality_rules.BASE] == brute_counts(t), t
        assert np.isfinite(docstats.ratios(t, c)).all()


def test_trees_are_monotone():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 0]) + 0.4 * x[:, 1] + 0.2 * rng.normal(size=3000)) < 0.7).astype(int)
    t = quality_rules.boost(x, y, np.array([-1, 0, 0]))
    grid = np.linspace(0, 1, 200)
    for b in (0.1, 0.5, 0.9):
        s = t.scores(np.stack([grid, np.full(200, b), np.full(200, 0.5)], 1))
        assert (np.diff(s) <= 1e-12).all()
    assert ((t.scores(x) > 0.5) == (y == 1)).mean() > 0.75
    one = t.scores(x[:1])

    def walk(k, row):  # the same tree by hand
        while t.feature[k] >= 0:
            k = t.left[k] if row[t.feature[k]] <= t.cut[k] else t.right[k]
        return t.value[k]

    assert np.isclose(one[0], 1 / (1 + np.exp(-sum(walk(r, x[0]) for r in t.root))))
