"""Embedding whitening by hierarchical merging of singular value decompositions.

Each partition of the fit list (the distinct integer vectors) keeps its number of vectors, their exact sums, and all singular
values and right singular vectors of its centred rows. Two summaries merge by stacking their scaled singular vectors and one row
that corrects the means, sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), and decomposing the stack again: nothing is cut off, so the last
summary has the spectrum of all rows. Partitions merge `FAN` at a time, in rounds, each written to the shared folder. A summary has
d * d numbers, whatever the number of rows; only the last one reaches the driver.

Rows whose vector is null, has no entries, or holds null or non-finite entries are dropped; other nulls stay. An entry c becomes
floor(scale * c); one of 2^31 or more, and vectors of unlike length, raise an error. Equal vectors count once in the fit and are
whitened alike; repeated rows each get a result. Components of no variance (to rounding) can't be whitened and are left out,
so one distinct vector, or an empty table, gives no rows. Equal eigenvalues may be numbered either way. Texts play no part. The row's
other columns travel as one struct, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read

SCALE, COMPONENTS = 256, 4
#: Summaries that one task merges; rows that are decomposed at once.
FAN, BLOCK = 16, 4096
LIMIT = 1 << 31
_SUMMARY = "part int, n long, sums array<long>, s array<double>, vt array<double>"


class Summary(NamedTuple):
    n: int
    sums: np.ndarray
    s: np.ndarray
    vt: np.ndarray


class Whitening(NamedTuple):
    """n, the exact sums, all eigenvalues of the covariance, and the first components (a row each)."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues[: len(self.components)] / self.eigenvalues.sum()

    def project(self, x: np.ndarray) -> np.ndarray:
        k = len(self.components)
        return (x - self.sums / self.n) @ (self.components / np.sqrt(self.eigenvalues[:k])[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2, as n^2 sum x^2 - 2 n sum x S + sum S^2."""
        bound = max(int(np.abs(x).max(initial=0)), 1) * max(int(np.abs(self.sums).max()), int(np.abs(x).max(initial=0))) * x.shape[1]
        wide, sums = (x, self.sums) if bound < 1 << 62 else (x.astype(object), self.sums.astype(object))
        squares, mixed, own = (wide * wide).sum(1).tolist(), (wide * sums).sum(1).tolist(), sum(int(v) ** 2 for v in self.sums)
        return [self.n * self.n * a - 2 * self.n * b + own for a, b in zip(squares, mixed, strict=True)]


def _spectrum(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.svd(np.linalg.qr(stack, mode="r") if len(stack) > stack.shape[1] else stack, full_matrices=False)[1:]


def summary(x: np.ndarray) -> Summary:
    sums = x.sum(0)
    return Summary(len(x), sums, *_spectrum(x - sums / len(x)))


def merged(a: Summary, b: Summary) -> Summary:
    shift = np.sqrt(a.n * b.n / (a.n + b.n)) * (a.sums / a.n - b.sums / b.n)
    return Summary(a.n + b.n, a.sums + b.sums, *_spectrum(np.vstack([a.s[:, None] * a.vt, b.s[:, None] * b.vt, shift[None]])))


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(column):
        return flat.reshape(0, 0)
    if len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def _batch(part: int, x: Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [x.n], "sums": [x.sums.tolist()], "s": [x.s.tolist()], "vt": [x.vt.ravel().tolist()]})


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total: Summary | None = None
    for b in batches:
        x = vectors_of(b.column(0))
        for k in range(0, len(x), BLOCK):
            own = summary(x[k : k + BLOCK])
            if total is not None and len(total.sums) != len(own.sums):
                raise ValueError("vectors differ in length")
            total = own if total is None else merged(total, own)
    if total is not None:
        yield _batch(TaskContext.get().partitionId(), total)


def _merge(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["part"])
    if len({len(r["sums"]) for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    total: Summary | None = None
    for r in rows:
        own = Summary(r["n"], np.array(r["sums"], dtype=np.int64), np.array(r["s"]), np.array(r["vt"]).reshape(len(r["s"]), -1))
        total = own if total is None else merged(total, own)
    return pa.Table.from_batches([_batch(rows[0]["part"] // FAN, total)])


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row (the other columns as a struct) and x, for rows whose vector is whole."""
    whole = F.forall(vector, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    entry = lambda e: F.when(F.abs(e * scale) < LIMIT, F.floor(e * scale)).otherwise(F.raise_error(F.lit("an entry is out of range")).cast("bigint"))
    rest = [F.col(f"`{c}`") for c in rows.columns if c != vector]
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(whole, F.lit(False)))
    return kept.select(F.struct(*rest).alias("row"), F.transform(F.col(vector).cast("array<double>"), entry).alias("x"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From x of a stored table of distinct vectors; None if there are none."""
    level = materialize(vectors.select("x").mapInArrow(_summarise, _SUMMARY))
    while (rows := level.count()) > 1:
        fan = FAN if rows > FAN else 0
        group = (F.col("part") / FAN).cast("int") if fan else F.lit(0)
        level = materialize(level.withColumn("g", group).groupBy("g").applyInArrow(lambda t: _merge(t.drop_columns(["g"])), _SUMMARY))
    last = level.first()
    if last is None:
        return None
    s, vt = np.array(last["s"]), np.array(last["vt"]).reshape(len(last["s"]), -1)
    rank = int((s > s[0] * max(last["n"], len(s)) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    return Whitening(last["n"], np.array(last["sums"], dtype=np.int64), s**2 / last["n"], vt[: min(components, rank)])


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity. One aggregate: pairs of components are its columns."""
    k = len(model.components)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(w) for w in model.project(vectors_of(b.column(0))).T], [f"w{i}" for i in range(k)])

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = vectors.select("x").mapInArrow(of, ", ".join(f"w{i} double" for i in range(k)))
    got = w.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """Of rows with row and x: row, deviation (decimal: exact at any n) and whitened, an array with an entry a component."""
    kind = rows.schema["row"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = vectors_of(b.column(1))
            w = model.project(x)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(Decimal, model.deviations(x)), pa.decimal128(38, 0)), lists], ["row", "deviation", "whitened"])

    return rows.select("row", "x").mapInArrow(of, f"row {kind}, deviation decimal(38,0), whitened array<double>")


def op12_whitening(spark, sf_dir):
    """deviation is a long by contract: beyond that (n^2 times squares, from some 10^7 vectors on) the cast fails rather than wraps."""
    rows = quantised(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    distinct = materialize(rows.select("x").distinct())
    model = fit(distinct)
    if model is None or not len(model.components):
        shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], shape)
    out = whiten(rows, model).select("row.vec_id", F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    share = F.array(*(F.lit(float(v)) for v in model.explained))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(float(identity_error(distinct, model))).alias("identity_error"))
