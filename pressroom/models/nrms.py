"""A neural news ranker's inference (training: nrms_fit.py): word vectors, self-attention, additive attention; dot product of user and news.

Weights are numpy arrays (fixed by a seed, or read from an npz file). The catalogue is encoded once into a table of vectors;
impressions gather what they need by joins, so no executor holds the catalogue. The padding code 0 has a vector, too: attention isn't
masked, so padding weighs in as it did in training."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.held import Held, held
from ..sources.shared import stored


@dataclass
class Weights:
    words: np.ndarray  # vocabulary + 1, word dimension
    nq: np.ndarray  # news encoder: heads, in, out
    nk: np.ndarray
    nv: np.ndarray
    nw: np.ndarray
    nb: np.ndarray
    na: np.ndarray
    uq: np.ndarray  # user encoder
    uk: np.ndarray
    uv: np.ndarray
    uw: np.ndarray
    ub: np.ndarray
    ua: np.ndarray
    f1: np.ndarray | None = None  # freshness head, of that arm only: 2 to hidden to 1, with biases; its output is zero at the start
    g1: np.ndarray | None = None
    f2: np.ndarray | None = None
    g2: np.ndarray | None = None

    @property
    def fresh(self) -> bool:
        return self.f1 is not None

    def arrays(self) -> dict[str, np.ndarray]:
        return {f.name: x for f in fields(self) if (x := getattr(self, f.name)) is not None}

    @classmethod
    def seeded(cls, vocabulary: int, word: int = 32, heads: int = 4, size: int = 8, attention: int = 16, hidden: int = 16, seed: int = 42, freshness: bool = False) -> Weights:
        """The head is drawn last, so all other weights are those of the arm without it."""
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2] if len(s) > 1 else s[0]), s)
        d = heads * size
        return cls(g(vocabulary + 1, word), *(g(heads, word, size) for _ in range(3)), g(d, attention), np.zeros(attention), g(attention), *(g(heads, d, size) for _ in range(3)), g(d, attention), np.zeros(attention), g(attention), *((g(2, hidden), np.zeros(hidden), np.zeros(hidden), np.zeros(1)) if freshness else ()))

    def save(self, path: str) -> None:
        np.savez(path, **self.arrays())

    @classmethod
    def load(cls, path: str) -> Weights:
        """The names in the file say which arm it is."""
        with np.load(path) as z:
            return cls(**{name: z[name] for name in z.files})


def self_attention(x: np.ndarray, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """x: batch, length, dimension to batch, length, heads * size. Unmasked."""
    # A product an item, not one of all rows: what an item gets doesn't depend on its batch, to the last bit, so equal titles have equal vectors.
    each = lambda w: (x @ w.transpose(1, 0, 2).reshape(x.shape[-1], -1)).reshape(*x.shape[:2], len(w), -1).transpose(0, 2, 1, 3)
    a = each(q) @ each(k).transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1])  # batch, head, length, length
    a = np.exp(a - a.max(-1, keepdims=True))
    a /= a.sum(-1, keepdims=True)
    out = a @ each(v)
    return out.transpose(0, 2, 1, 3).reshape(len(x), x.shape[1], -1)


def additive_attention(x: np.ndarray, w: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x: batch, length, dimension to batch, dimension."""
    a = np.tanh(x @ w + b) @ q
    a = np.exp(a - a.max(-1, keepdims=True))
    a /= a.sum(-1, keepdims=True) + 1e-7
    return np.einsum("bl,bld->bd", a, x)


def encode_news(tokens: np.ndarray, m: Weights) -> np.ndarray:
    return additive_attention(self_attention(m.words[tokens], m.nq, m.nk, m.nv), m.nw, m.nb, m.na)


def encode_user(news: np.ndarray, m: Weights) -> np.ndarray:
    return additive_attention(self_attention(news, m.uq, m.uk, m.uv), m.uw, m.ub, m.ua)


def freshness_logit(age: np.ndarray, known: np.ndarray, m: Weights) -> np.ndarray:
    return np.maximum(np.stack([age, known], -1) @ m.f1 + m.g1, 0) @ m.f2 + m.g2[0]


def freshness_column(age: Column, known: Column, m: Weights) -> Column:
    """freshness_logit as an expression of columns."""
    units = zip(m.f1[0], m.f1[1], m.g1, m.f2, strict=True)
    return sum((F.greatest(age * float(a) + known * float(k) + float(g), F.lit(0.0)) * float(f) for a, k, g, f in units), F.lit(float(m.g2[0])))


def article_vectors(tokens: DataFrame, m: Weights) -> DataFrame:
    """tokens: code, tokens to code, v; the padding's row (code 0) is added."""
    length = len(tokens.first()["tokens"])
    pad = tokens.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("code"), F.array(*[F.lit(0)] * length).alias("tokens"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = np.array(b.column(1).to_pylist(), dtype=np.int64).reshape(b.num_rows, length)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(encode_news(t, m)), pa.list_(pa.float64()))], ["code", "v"])

    return tokens.select(F.col("code").cast("bigint").alias("code"), "tokens").unionByName(pad).mapInArrow(of, "code bigint, v array<double>")


def _alike(vectors: DataFrame) -> DataFrame:
    """code, rep, v: articles of equal vectors have one rep, the least code."""
    own = stored(vectors)  # encoded once
    reps = own.groupBy("v").agg(F.min("code").alias("rep"))
    return stored(own.join(reps.hint("merge"), "v").select("code", "rep", "v"))


def _scores_held(impressions: DataFrame, reps: DataFrame, few: Held, m: Weights) -> DataFrame:
    """scores, where each task holds all different vectors: only numbers of vectors travel to an impression, and padding doesn't travel at all."""
    own = lambda c, kind: impressions.select("imp", F.size("history").alias("size"), F.lit(kind).alias("kind"), F.posexplode(c).alias("i", "code"))
    all_ = own("history", 0).where("code <> 0").unionByName(own("candidates", 1)).join(reps.hint("merge"), "code")
    rows = all_.groupBy("imp").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("kind", "i", F.col("code").cast("bigint").alias("code"), F.col("rep").cast("bigint").alias("rep")))).alias("x"))
    rows = rows.select("imp", "size", F.col("x.kind").alias("kind"), F.col("x.i").alias("i"), F.col("x.code").alias("code"), F.col("x.rep").alias("rep"))
    padding = reps.where("code = 0").first()
    pad = np.searchsorted(few.ids, padding["rep"]) if padding else 0

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                kind, i, code, rep = (b.column(k).flatten().to_numpy() for k in range(2, 6))
                row, at = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy())), np.searchsorted(few.ids, rep)
                news = np.full((b.num_rows, b.column(1)[0].as_py()), pad)
                old, new = kind == 0, kind == 1
                news[row[old], i[old]] = at[old]
                score = (encode_user(few.e[news], m)[row[new]] * few.e[at[new]]).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[new])), pa.array(i[new] + 1, pa.int32()), pa.array(code[new]), pa.array(score)], ["imp", "pos", "code", "score"])

    out = rows.mapInArrow(of, T.StructType([rows.schema["imp"], *(T.StructField(c, kind) for c, kind in (("pos", T.IntegerType()), ("code", T.LongType()), ("score", T.DoubleType())))]))
    return out.withColumn("code", F.col("code").cast(impressions.schema["candidates"].dataType.elementType))


def scores(impressions: DataFrame, vectors: DataFrame, m: Weights) -> DataFrame:
    """impressions: imp, history (codes, padded to one length), candidates (codes, in place order, from 1). Returns imp, pos, code, score.
    The arm with freshness needs log_age (ln of 1 + hours) and known (0 or 1), too, of each candidate; the other looks at neither."""
    if m.fresh and not {"log_age", "known"} <= set(impressions.columns):
        raise ValueError("these weights have a freshness head: give log_age and known of the candidates")
    if not m.fresh:
        alike = _alike(vectors)
        few = held(alike.select(F.col("rep").alias("vec"), F.col("v").alias("e")).distinct())
        if few is not None:
            return _scores_held(impressions, alike.select("code", "rep"), few, m)
    vectors = vectors.hint("merge")  # as many as articles: what Spark takes for their size is that of the titles, and none goes through the driver
    h = impressions.select("imp", F.posexplode("history").alias("i", "code")).join(vectors, "code").groupBy("imp").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("h"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = encode_user(np.array(b.column(1).to_pylist()), m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(u), pa.list_(pa.float64()))], ["imp", "u"])

    from ..functions.vectors import dot

    users = h.mapInArrow(of, "imp bigint, u array<double>")
    names = ["candidates", *(["log_age", "known"] if m.fresh else [])]
    long = impressions.select("imp", F.posexplode(F.arrays_zip(*names)).alias("p", "x")).select("imp", "p", F.col("x.candidates").alias("code"), *(f"x.{n}" for n in names[1:]))
    score = dot(F.col("u"), F.col("v"))
    if m.fresh:
        score = score + freshness_column(F.col("log_age"), F.col("known"), m)
    return long.join(vectors, "code").join(users, "imp").select("imp", (F.col("p") + 1).alias("pos"), "code", score.alias("score"))
