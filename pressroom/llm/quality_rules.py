"""Quality rules: gradient-boosted trees over document statistics.

Histogram trees with Newton leaves for the logistic loss, grown to a fixed depth on a bounded sample of labelled rows. On
the features named in MONOTONE a split is allowed only if it keeps the sign, and each side's leaves are bounded by the
middle of the two, so the score never goes the wrong way. The trees are flattened to node arrays; a batch is scored by
walking all its rows down together.

Null and empty texts have no words and fail the base rule; very long ones are counted whole. A row's result depends on its text alone,
so ties and repeated rows have the same. An empty table gives an empty one; without labels of both classes every score is 0.5. The document
travels as one struct, so its other columns may have any names. doc_id is a number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .docstats import RATIOS, counts, ratios
from .fm import ROWS_A_CLASS, labelled
from .toxicity import fold

#: -1: more of it never raises the score.
MONOTONE = {"symbols_a_word": -1, "repeated_windows": -1, "equal_neighbours": -1, "dup_lines": -1, "bangs_a_word": -1}
THRESHOLD = 0.3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf has feature -1."""

    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for r in self.root:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                f = self.feature[at]
                go = x[rows, np.maximum(f, 0)] <= self.cut[at]
                at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
            out += self.value[at]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, sign: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: float = 20.0, l2: float = 1.0) -> Trees:
    y = np.asarray(y, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart
        return Trees(np.zeros(0, dtype=np.int64), *(np.zeros(0, dtype=t) for t in (np.int64, float, np.int64, np.int64, float)), depth, 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    raw = np.zeros(len(y))
    roots, nodes = [], []  # node: [feature, cut, left, right, value]
    value = lambda g, h, lo, hi: float(np.clip(-g / (h + l2), lo, hi))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = (p - y) * weight, p * (1 - p) * weight
        roots.append(len(nodes))
        nodes.append(None)
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, lo, hi = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            best = None
            for j in range(x.shape[1]) if level < depth else ():
                k = len(edges[j]) + 1
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = sg - gl, sh - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - sg**2 / (sh + l2)
                gain[(nl < leaf) | (nr < leaf) | ((vr - vl) * sign[j] < 0)] = -1
                if len(gain) and (m := int(np.argmax(gain))) is not None and gain[m] > (best[0] if best else 1e-6):
                    best = (gain[m], j, m, vl[m], vr[m])
            if best is None:
                v = value(sg, sh, lo, hi) * rate
                nodes[at] = [-1, 0.0, at, at, v]
                raw[rows] += v
                continue
            _, j, m, vl, vr = best
            mid = (vl + vr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), -1: ((max(lo, mid), hi), (lo, min(hi, mid))), 1: ((lo, min(hi, mid)), (max(lo, mid), hi))}[int(sign[j])]
            a = len(nodes)
            nodes += [None, None]
            nodes[at] = [j, edges[j][m], a, a + 1, 0.0]
            goes = binned[rows, j] <= m
            todo += [(a, rows[goes], level + 1, *bounds[0]), (a + 1, rows[~goes], level + 1, *bounds[1])]
    f, c, lt, rt, v = zip(*nodes, strict=True)
    return Trees(np.array(roots), np.array(f), np.array(c, dtype=float), np.array(lt), np.array(rt), np.array(v), depth, 0.0)


def fit_rules(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> Trees:
    """Trained on the rows whose crc32(doc_id) mod 5 isn't 0, so that the others can test it."""
    _, x, y, _ = labelled(docs, labels, "quality", fold(5) != 0, stats=True, words=False, rows_a_class=rows_a_class)
    return boost(x, y, np.array([MONOTONE.get(n, 0) for n in RATIOS]))


def judge(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """row, the base counts, base_failed, score and kept."""

    at = docs.columns.index("text")  # the text goes to Python once, inside the row

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field(at).to_pylist()
            cs = [counts(t)[0] for t in texts]
            s = trees.scores(np.array([ratios(t, c) for t, c in zip(texts, cs, strict=True)]).reshape(len(cs), len(RATIOS)))
            failed = np.array([c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"] for c in cs], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([c[k] for c in cs], pa.int64()) for k in BASE), pa.array(failed, pa.bool_()), pa.array(s, pa.float64()), pa.array(~failed & (s >= threshold), pa.bool_())], ["row", *BASE, "base_failed", "score", "kept"])

    packed = docs.select(F.struct("*").alias("row"))
    shape = packed.select("row", *(F.lit(0).cast("long").alias(k) for k in BASE), F.lit(True).alias("base_failed"), F.lit(0.0).alias("score"), F.lit(True).alias("kept")).schema
    return packed.mapInArrow(of, shape)


def op5_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit_rules(docs, read(spark, sf_dir, "labels"))).select("row.doc_id", *BASE, "base_failed", "score", "kept")
