"""Training of the neural ranker: cross-entropy over a click and its sampled negatives, Adam, stop on validation AUC.

Rounds of local training and averaging: in an epoch each of `workers` tasks trains a copy of the weights on its part of the rows, and
the copies are averaged by rows. A task streams its rows in batches, and the driver holds one set of weights a worker, whatever the
number of rows. Rows are dealt and ordered by a hash of impression and epoch, so a task that is run again does the same."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.shared import stored
from . import nrms

EPOCHS, BATCH, RATE, DROPOUT, WORKERS = 5, 32, 1e-4, 0.2, 8
#: With more epochs than PLATEAU without a gain the rate is cut, down to LEAST_RATE; with STOP of them training ends.
PLATEAU, CUT, LEAST_RATE, STOP = 2, 0.2, 1e-6, 4


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _self_attention_back(x: np.ndarray, q: np.ndarray, k: np.ndarray, v: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """The gradient at the output to those of x, q, k, v."""
    heads, _, size = q.shape
    xq, xk, xv = (np.einsum("bld,hds->bhls", x, w) for w in (q, k, v))
    a = _softmax(xq @ xk.swapaxes(-1, -2) / np.sqrt(size))
    out = out.reshape(len(x), x.shape[1], heads, size).transpose(0, 2, 1, 3)
    da = out @ xv.swapaxes(-1, -2)
    ds = a * (da - (da * a).sum(-1, keepdims=True)) / np.sqrt(size)
    back = (ds @ xk, ds.swapaxes(-1, -2) @ xq, a.swapaxes(-1, -2) @ out)
    dx = sum(np.einsum("bhls,hds->bld", g, w) for g, w in zip(back, (q, k, v), strict=True))
    return dx, *(np.einsum("bld,bhls->hds", x, g) for g in back)


def _additive_back(x: np.ndarray, w: np.ndarray, b: np.ndarray, q: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """The gradient at the output to those of x, w, b, q."""
    t = np.tanh(x @ w + b)
    a = _softmax(t @ q)
    da = np.einsum("bd,bld->bl", out, x)
    dz = a * (da - (a * da).sum(-1, keepdims=True))
    du = dz[..., None] * q * (1 - t**2)
    return a[..., None] * out[:, None] + du @ w.T, np.einsum("bld,blk->dk", x, du), du.sum((0, 1)), np.einsum("bl,blk->k", dz, t)


def gradients(m: nrms.Weights, history: np.ndarray, candidates: np.ndarray, label: np.ndarray, age: np.ndarray | None = None, known: np.ndarray | None = None,
              dropout: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and its gradient by weight. history: batch, clicks, title; candidates: batch, choices, title; label: the clicked one's place."""
    n, clicks, title = history.shape
    choices = candidates.shape[1]
    tokens = np.concatenate([history.reshape(-1, title), candidates.reshape(-1, title)])
    x = m.words[tokens]
    mask = (rng.random(x.shape) >= dropout) / (1 - dropout) if dropout and rng is not None else None
    x = x if mask is None else x * mask
    inner = nrms.self_attention(x, m.nq, m.nk, m.nv)
    news = nrms.additive_attention(inner, m.nw, m.nb, m.na)
    read, offered = news[: n * clicks].reshape(n, clicks, -1), news[n * clicks :].reshape(n, choices, -1)
    mixed = nrms.self_attention(read, m.uq, m.uk, m.uv)
    user = nrms.additive_attention(mixed, m.uw, m.ub, m.ua)
    logit = np.einsum("bcd,bd->bc", offered, user)
    if m.fresh:
        logit = logit + nrms.freshness_logit(age, known, m)
    p = _softmax(logit)
    loss = float(-np.log(np.maximum(p[np.arange(n), label], 1e-300)).mean())
    d = p.copy()
    d[np.arange(n), label] -= 1
    d /= n
    g: dict[str, np.ndarray] = {}
    if m.fresh:
        seen = np.stack([age, known], -1)
        hidden = seen @ m.f1 + m.g1
        dh = d[..., None] * m.f2 * (hidden > 0)
        g["f2"], g["g2"] = np.einsum("bc,bch->h", d, np.maximum(hidden, 0)), np.array([d.sum()])
        g["f1"], g["g1"] = np.einsum("bci,bch->ih", seen, dh), dh.sum((0, 1))
    d_offered, d_user = d[..., None] * user[:, None], np.einsum("bc,bcd->bd", d, offered)
    d_mixed, g["uw"], g["ub"], g["ua"] = _additive_back(mixed, m.uw, m.ub, m.ua, d_user)
    d_read, g["uq"], g["uk"], g["uv"] = _self_attention_back(read, m.uq, m.uk, m.uv, d_mixed)
    d_news = np.concatenate([d_read.reshape(n * clicks, -1), d_offered.reshape(n * choices, -1)])
    d_inner, g["nw"], g["nb"], g["na"] = _additive_back(inner, m.nw, m.nb, m.na, d_news)
    dx, g["nq"], g["nk"], g["nv"] = _self_attention_back(x, m.nq, m.nk, m.nv, d_inner)
    g["words"] = np.zeros_like(m.words)
    np.add.at(g["words"], tokens, dx if mask is None else dx * mask)
    return loss, g


class Adam:
    def __init__(self, m: nrms.Weights, rate: float):
        self.m, self.rate, self.t = m, rate, 0
        self.first, self.second = ({k: np.zeros_like(x) for k, x in m.arrays().items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in self.m.arrays().items():
            self.first[k] += 0.1 * (grads[k] - self.first[k])
            self.second[k] += 0.001 * (grads[k] ** 2 - self.second[k])
            x -= self.rate * (self.first[k] / (1 - 0.9**self.t)) / (np.sqrt(self.second[k] / (1 - 0.999**self.t)) + 1e-8)


def samples(impressions: DataFrame, tokens: DataFrame) -> DataFrame:
    """impressions: imp, history (codes, padded), candidates (as many in each), label (place from 0), and log_age, known for the arm with
    freshness; codes become their titles' tokens, 0 and unknown ones the padding's. tokens: code, tokens."""
    length = len(tokens.first()["tokens"])
    pad = F.array_repeat(F.lit(0), length)

    def titles(name: str) -> DataFrame:
        long = impressions.select("imp", F.posexplode(name).alias("i", "code")).join(tokens, "code", "left")
        return long.groupBy("imp").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("tokens", pad).alias("t")))).alias("x")).select("imp", F.transform("x", lambda x: x["t"]).alias(name))

    return impressions.drop("history", "candidates").join(titles("history"), "imp").join(titles("candidates"), "imp")


def auc(impressions: DataFrame, tokens: DataFrame, m: nrms.Weights) -> float:
    """Mean AUC of impressions as in `samples`."""
    scored = nrms.scores(impressions, nrms.article_vectors(tokens, m), m).join(impressions.select("imp", (F.col("label") + 1).alias("clicked")), "imp")
    scored = scored.select("imp", "pos", "score", (F.col("pos") == F.col("clicked")).cast("int").alias("label"))
    return metrics.per_impression(scored).agg(F.avg("auc")).first()[0] or 0.0


def _pack(m: nrms.Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **m.arrays())
    return out.getvalue()


def _epoch(m: nrms.Weights, rows: DataFrame, epoch: int, workers: int, batch: int, rate: float, dropout: float) -> tuple[nrms.Weights, float]:
    """The average of what the workers make of m, and their mean loss."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(m, **{k: x.copy() for k, x in m.arrays().items()})
        adam, rng, n, total = Adam(own, rate), np.random.default_rng(epoch), 0, 0.0
        for b in batches:
            cols = {c: b.column(k).to_pylist() for k, c in enumerate(b.schema.names)}
            for k in range(0, b.num_rows, batch):
                part = {c: np.array(x[k : k + batch]) for c, x in cols.items()}
                loss, g = gradients(own, part["history"], part["candidates"], part["label"], part.get("log_age"), part.get("known"), dropout, rng)
                adam.step(g)
                n, total = n + len(part["label"]), total + loss * len(part["label"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([_pack(own)], pa.binary())], ["n", "loss", "w"])

    place = F.xxhash64(F.lit(epoch), "imp")
    dealt = rows.withColumn("place", place).repartition(workers, "place").sortWithinPartitions("place").drop("place")
    made = dealt.mapInArrow(of, "n bigint, loss double, w binary").collect()  # a row a worker
    if not made:
        return m, 0.0
    n = sum(r.n for r in made)
    sums = {k: np.zeros_like(x) for k, x in m.arrays().items()}
    for r in made:
        with np.load(io.BytesIO(bytes(r.w))) as z:
            for k in sums:
                sums[k] += z[k] * (r.n / n)
    return replace(m, **sums), sum(r.loss for r in made) / n


def fit(m: nrms.Weights, train: DataFrame, val: DataFrame, tokens: DataFrame, epochs: int = EPOCHS, workers: int = WORKERS, batch: int = BATCH, rate: float = RATE,
        dropout: float = DROPOUT) -> tuple[nrms.Weights, list[dict]]:
    """train, val: as in `samples`. The weights of the epoch with the best validation AUC, and a line for each epoch. An empty training table returns m."""
    rows, best, since, bad, log = stored(samples(train, tokens)), m, 0, 0, []
    top = float("-inf")
    for epoch in range(epochs):
        m, loss = _epoch(m, rows, epoch, workers, batch, rate, dropout)
        now = auc(val, tokens, m)
        log.append({"epoch": epoch, "loss": loss, "auc": now, "rate": rate})
        if now > top:
            best, top, since, bad = m, now, 0, 0
        else:
            since, bad = since + 1, bad + 1
            if bad > PLATEAU:
                rate, bad = max(rate * CUT, LEAST_RATE), 0
            if since >= STOP:
                break
    return best, log
