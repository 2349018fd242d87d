"""Factorisation machine for texts: y = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j.

The pairwise sum is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a document costs time linear in its terms.
Terms are hashed to 2**BITS buckets: words in lower case, and their first four and five letters. Of the buckets, all those that
tell the classes apart significantly in the training rows are kept, the others weigh nothing; statistics are cut into equal-count
bins. Fitted on the driver on a bounded sample of labelled rows; scored by executors over whole texts.

Executors make the sample's terms and count them by bucket and class. Only the kept buckets come to the driver, and the sample's
rows reduced to them; the fit runs on index lists, without a matrix of rows by terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of
from .docstats import RATIOS, counts, ratios

BITS, PREFIXES, BINS, FACTORS = 20, (4, 5), 12, 8
#: A bucket is kept if it is in LEAST training rows or more and the classes' shares differ by SIGNIFICANT standard errors.
LEAST, SIGNIFICANT = 5, 4.0
#: Labelled rows of each class that a fit takes at most; which ones, a hash of doc_id decides.
ROWS_A_CLASS = 4_000


class Terms(dict):
    """Hash buckets of a text's terms, or, given the kept ones, their features. Words are numbered as they come; a table has the terms of each."""

    def __init__(self, keep: dict[int, int] | None = None, bound: int = 250_000):
        self.keep, self.bound = keep, bound
        self.table = np.full((1024, 1 + len(PREFIXES)), -1, dtype=np.int32)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        self.table[k] = -1
        low = word.decode("utf-8", "surrogatepass").strip(".,;:!?\"'()[]").lower()
        if low:
            for j, x in enumerate((low, *(low[:n] for n in PREFIXES))):
                bucket = crc32((b"^%d" % PREFIXES[j - 1] if j else b"") + x.encode("utf-8", "surrogatepass")) >> (32 - BITS)
                self.table[k, j] = bucket if self.keep is None else self.keep.get(bucket, -1)
        return k

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Sorted and distinct."""
        if len(self) > self.bound:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        out = np.unique(self.table[at])
        return out[np.searchsorted(out, 0) :]


def raw_features(text: str | None, stats: bool) -> tuple[list[bytes], list[float]]:
    """Words and, if asked for, the statistics of a whole text."""
    if not stats:
        return words_of(text), []
    c, words = counts(text)
    return words, ratios(text, c)


@dataclass
class Model:
    """A fitted machine; keep: bucket to feature, edges: the bins' inner edges of each statistic."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    keep: dict[int, int]
    edges: list[np.ndarray]
    stats: bool
    memo: Terms | None = field(default=None, repr=False)

    def columns(self, text: str | None) -> np.ndarray:
        """The document's features that are 1."""
        if self.memo is None:
            self.memo = Terms(self.keep)
        words, s = raw_features(text, self.stats)
        bins, n = [], len(self.keep)
        for x, e in zip(s, self.edges, strict=True):
            bins.append(n + int(np.searchsorted(e, x, side="right")))
            n += len(e) + 1
        return np.concatenate([self.memo(words), np.array(bins, dtype=np.int64)])

    def scores(self, texts: list[str | None], at_once: int = 128) -> np.ndarray:
        """at_once: texts whose features' factors are held together."""
        out = [np.zeros(0)]
        for k in range(0, len(texts), at_once):
            x = Rows([self.columns(t) for t in texts[k : k + at_once]], len(self.w))
            out.append(self.w0 + machine(x, self.w, self.v)[0])
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30)))


class Rows:
    """Rows of 0/1 features as one list of column numbers; sums by row and by column."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.size, self.columns = np.array([len(r) for r in rows]), columns
        self.at = np.concatenate(rows).astype(np.int64)

    def by_column(self) -> None:
        """What `back` needs."""
        row, order = np.repeat(np.arange(len(self.size)), self.size), np.argsort(self.at, kind="stable")
        self.order, self.count = row[order], np.bincount(self.at, minlength=self.columns)

    @staticmethod
    def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(size), *x.shape[1:]))
        some = size > 0
        if some.any():
            out[some] = np.add.reduceat(x, (np.cumsum(size) - size)[some], axis=0)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        """X w."""
        return self._sums(w[self.at], self.size)

    def back(self, g: np.ndarray) -> np.ndarray:
        """X' g."""
        return self._sums(g[self.order], self.count)


def machine(x: Rows, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear and pairwise sums of each row, by the sum-of-squares identity, and X v. x is 0 or 1: x*x = x."""
    sums = x.dot(np.column_stack([w, (v**2).sum(1), v]))
    xv = sums[:, 2:]
    return sums[:, 0] + 0.5 * ((xv**2).sum(1) - sums[:, 1]), xv


def fit(rows: list[np.ndarray], numbers: np.ndarray, y: np.ndarray, keep: dict[int, int], factors: int = FACTORS, epochs: int = 20, steps: int = 300, batch: int = 512, rate: float = 0.03, l2: float = 3e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss in batches, `epochs` times over the rows and `steps` steps at least, classes weighted alike. rows: kept features,
    by number; numbers: statistics, no columns for none. Without both classes the machine says 0.5."""
    y = np.asarray(y, dtype=np.float64)
    stats = numbers.shape[1] > 0
    if len(set(y.tolist())) < 2:
        return Model(0.0, np.zeros(0), np.zeros((0, factors)), {}, [], False)
    edges = [np.unique(np.quantile(numbers[:, k], np.arange(1, BINS) / BINS)) for k in range(numbers.shape[1])]
    n, bins = len(keep), []
    for k, e in enumerate(edges):
        bins.append(n + np.searchsorted(e, numbers[:, k], side="right"))
        n += len(e) + 1
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y).mean())
    batches = []
    for own in np.array_split(rng.permutation(len(y)), -(-len(y) // batch)):
        x = Rows([np.concatenate([rows[i], *(b[i : i + 1] for b in bins)]) for i in own], n)
        x.by_column()
        batches.append((x, y[own], weight[own] / len(own)))
    spread = min(0.05, 0.35 / max(1.0, np.mean([len(r) for r in rows])) ** 0.5)  # so that the pairwise sum of a row starts small
    par = [np.zeros(1), np.zeros(n), rng.normal(0, spread, (n, factors))]
    m1, m2, t = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par], 0
    for _ in range(max(epochs, -(-steps // len(batches)))):
        for b in rng.permutation(len(batches)):
            x, own_y, own_weight = batches[b]
            t += 1
            out, xv = machine(x, par[1], par[2])
            g = (1 / (1 + np.exp(-np.clip(par[0] + out, -30, 30))) - own_y) * own_weight
            back = x.back(np.column_stack([g, g[:, None] * xv]))
            grads = [np.array([g.sum()]), back[:, 0] + l2 * par[1] / 10, back[:, 1:] - back[:, :1] * par[2] + l2 * par[2]]
            for k in range(3):
                m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                m2[k] = 0.99 * m2[k] + 0.01 * grads[k] ** 2
                par[k] = par[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)
    return Model(float(par[0][0]), par[1], par[2], keep, edges, stats)


def significant(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """b of those rows of (b, pos, neg: training rows of each class with the bucket) that tell the classes apart."""
    n = float(n1 + n0)
    p = (F.col("pos") + F.col("neg")) / n
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    z = F.abs(F.col("pos") / float(n1) - F.col("neg") / float(n0)) / error
    return counts.where((F.col("pos") + F.col("neg") >= LEAST) & (z > SIGNIFICANT)).select("b")


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, stats: bool, words: bool = True, rows_a_class: int = ROWS_A_CLASS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, dict[int, int]]:
    """Kept terms by number, statistics, labels, and the numbers by bucket, of at most rows_a_class rows of each class among those for which `train` holds:
    the least by a hash of doc_id. A doc_id labelled more than once has its greatest label; null and other labels are passed over. Executors make the features of the whole texts."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & train)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    few = ids.where("y = 1").orderBy(order).limit(rows_a_class).unionByName(ids.where("y = 0").orderBy(order).limit(rows_a_class))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            made = [raw_features(t, stats) for t in b.column(1).to_pylist()]
            sets = [terms(w) if words else [] for w, _ in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sets, pa.list_(pa.int32())), pa.array([r for _, r in made], pa.list_(pa.float64()))], ["d", "y", "s", "r"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")  # 2 * rows_a_class rows
    made = own.select(F.col("doc_id").alias("d"), "text", "y").mapInArrow(of, "d long, y int, s array<int>, r array<double>")
    # Of rows equal in doc_id one counts, whatever the order of reading.
    made = materialize(made.groupBy("d").agg(F.min(F.struct("y", "s", "r")).alias("x")).select("d", "x.*"))
    n1, n0 = made.agg(F.count(F.when(F.col("y") == 1, 1)), F.count(F.when(F.col("y") == 0, 1))).first()
    keep: dict[int, int] = {}
    if n1 and n0 and words:
        by_bucket = made.select("y", F.explode("s").alias("b")).groupBy("b").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
        keep = {b: k for k, b in enumerate(sorted(r.b for r in significant(by_bucket, n1, n0).collect()))}  # 2**BITS at most
    table = np.array(sorted(keep), dtype=np.int32)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            flat, ends = b.column(2).flatten().to_numpy(), b.column(2).offsets.to_numpy() - b.column(2).offsets[0].as_py()
            at = np.searchsorted(table, flat)
            there = (table[np.minimum(at, len(table) - 1)] == flat) if len(table) else np.zeros(len(flat), dtype=bool)
            upto = np.concatenate([[0], np.cumsum(there)])[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(upto), pa.array(at[there].astype(np.int32))), b.column(3)], ["d", "y", "s", "r"])

    rows = made.mapInArrow(kept, made.schema).orderBy("d").toArrow()
    sets = [np.array(s, dtype=np.int64) for s in rows.column("s").to_pylist()]
    numbers = np.array(rows.column("r").to_pylist(), dtype=np.float64).reshape(rows.num_rows, len(RATIOS) * stats)
    return sets, numbers, rows.column("y").to_numpy().astype(np.int64), keep


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (the document as a struct, whatever its columns are called) and score, which depends on the text alone: repeated rows and ties
    score alike, null and empty texts as such. An empty table gives an empty one."""

    at = docs.columns.index("text")  # the text goes to Python once, inside the row

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(0).field(at).to_pylist()), pa.float64())], ["row", "score"])

    packed = docs.select(F.struct("*").alias("row"))
    return packed.mapInArrow(of, packed.withColumn("score", F.lit(0.0)).schema)
