"""Line dedup by hashes of all windows of words.

A document is its sequence of words (between blanks), whatever lines they stand in. A *window* is `run_words` words in a row.
A window that occurred earlier (by doc_id, then place) is a later copy, and all its words go. So every word of a later copy
of a passage of `run_words` words or more goes, wherever the passage begins, ends or is broken into lines, and no other word
does. A line that loses all its words goes whole; of a line that loses some, the others stay.

A task compares its own windows first, `HELD` at a time: those that are later copies there are later copies of all, and are cut at once.
The first place of each that is left is sent, as a 56-bit hash, to the partition of the least gram hash in it (`gram_words` words), the
winnowing fingerprint; a passage that all documents share is sent once a task, not once a document. Equal windows
have equal least grams and so meet there; windows in a row mostly have the same, so a document's windows travel in
runs, whose places compress to little. The first place of each window is found in the partition; pairs are never listed.

Nulls: a null text has no words and stays null; a null doc_id sorts last. Rows equal in doc_id and text are one document,
and don't delete each other's words. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, partitions, read, text_key, words_of

#: Words of the grams by which windows are dealt, and of a window.
GRAM_WORDS, RUN_WORDS = 25, 50
#: Windows that a task holds before it sends them on.
HELD = 2_000_000
#: Bytes of a window's hash that are sent; its partition tells more of it.
HASH = 7
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Hashes of all runs of n words, as differences of sums of hashes times powers of a base."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, h: np.ndarray, *sizes: int) -> list[np.ndarray]:
        if len(h) > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(h)), _powers(_BACK, 2 * len(h))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h) * self.up[: len(h)], dtype=np.uint64)])
        return [mix((sums[n:] - sums[:-n]) * self.down[: len(h) - n + 1]) for n in sizes]


def _bytes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(body: bytes, m: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * m, at).reshape(4, m).T).view("<u4").ravel()


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of each n in a row."""
    size = 1
    while 2 * size <= n:
        g, size = np.minimum(g[:-size], g[size:]), 2 * size
    return np.minimum(g[: len(g) - (n - size)], g[n - size :])


def _late(w: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Which windows have an equal one at an earlier place."""
    order = np.argsort(w)
    new = np.concatenate([[True], w[order][1:] != w[order][:-1]])
    first = np.empty_like(where)
    first[order] = np.minimum.reduceat(where[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return where > first


def _cuts(late: np.ndarray, table: np.ndarray, run_words: int) -> pa.Table:
    """Places (number of the document << 32 | word) of later copies, sorted, to d, t, cut: from and to of each run of words that they cover. table: null, d, t of the documents."""
    doc, place = late >> 32, late & 0xFFFFFFFF
    breaks = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + run_words)])
    start = np.flatnonzero(breaks)
    last = np.concatenate([start[1:], [len(late)]]) - 1
    runs = np.stack([place[start], place[last] + run_words], 1).astype(np.int32)
    one, begin = np.unique(doc[start], return_index=True)
    offsets = np.concatenate([begin, [len(start)]]).astype(np.int32) * 2
    d = pa.array(table[one, 1], pa.int64(), mask=table[one, 0] == 1)
    return pa.table({"d": d, "t": pa.array(table[one, 2], pa.int64()), "cut": pa.ListArray.from_arrays(offsets, pa.array(runs.ravel()))})


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _pack(parts: int, gram_words: int, run_words: int):
    """p, body: a partition's windows with their documents and places; or, behind a number of documents of -1, cuts that are found already."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, windows = WordHashes(), Windows()
        docs: list[tuple[bool, int, int]] = []
        found, home, held = [], [], 0

        def parcels() -> pa.RecordBatch:
            table, one = np.unique(np.array(docs, dtype=np.int64), axis=0, return_index=True)  # in the order of documents, each once
            size = np.array([len(found[i]) for i in one])
            w, p, doc = np.concatenate([found[i] for i in one]), np.concatenate([home[i] for i in one]), np.repeat(np.arange(len(one)), size)
            place = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            late = pd.Series(w).duplicated().to_numpy()  # by places: a hash table is quicker than a sort here
            to, bodies = [], []
            if late.any():
                cuts = _cuts(doc[late] << 32 | place[late], table, run_words)
                to.append(int(mix(w[:1])[0] % np.uint64(parts)))
                bodies.append(np.array([-1, len(cuts)], dtype="<i8").tobytes() + _stream(cuts))
                w, p, doc, place = w[~late], p[~late], doc[~late], place[~late]
            order = np.argsort(p, kind="stable")
            ends = np.searchsorted(p[order], np.arange(parts + 1))
            null, d, t = table.T
            for x in np.flatnonzero(np.diff(ends)):
                own = order[ends[x] : ends[x + 1]]
                of, where = doc[own], place[own]
                new = np.concatenate([[True], of[1:] != of[:-1]])
                one, at = of[new], np.cumsum(new) - 1
                raw = b"".join([d[one].astype("<i8").tobytes(), t[one].astype("<i8").tobytes(), null[one].astype(np.uint8).tobytes(), _bytes(np.diff(at, prepend=0)), _bytes(np.diff(where, prepend=0)), w[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH].tobytes()])
                to.append(int(x))
                bodies.append(np.array([len(one), len(own)], dtype="<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(bodies, pa.binary())], ["p", "body"])

        for b in batches:
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                if len(words) < run_words:
                    continue
                w, g = windows(hashes(words), run_words, gram_words)
                least = _least(g, run_words - gram_words + 1)
                docs.append((d is None, d or 0, t))
                found.append(w)
                home.append((mix(least) % np.uint64(parts)).astype(np.int16 if parts < 1 << 15 else np.int32))
                held += len(w)
                if held >= HELD:
                    yield parcels()
                    docs, found, home, held = [], [], [], 0
        if held:
            yield parcels()

    return of


def _later(run_words: int):
    """All windows of a partition to d, t, cut: from and to of each run of words that later copies cover, one after the other."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, at, place, w, n = [], [], [], [], 0
        for b in batches:
            for body in b.column(1).to_pylist():
                nd, m = (int(x) for x in np.frombuffer(body, "<i8", 2))
                if nd < 0:
                    yield from pa.ipc.open_stream(memoryview(body)[16:]).read_all().to_batches(max_chunksize=10_000)
                    continue
                raw = pa.decompress(memoryview(body)[16:], decompressed_size=17 * nd + (8 + HASH) * m, codec="zstd", asbytes=True)
                docs.append(np.stack([np.frombuffer(raw, np.uint8, nd, 16 * nd).astype(np.int64), np.frombuffer(raw, "<i8", nd), np.frombuffer(raw, "<i8", nd, 8 * nd)], 1))
                at.append(np.cumsum(_numbers(raw, m, 17 * nd), dtype=np.uint32).astype(np.int64) + n)
                place.append(np.cumsum(_numbers(raw, m, 17 * nd + 4 * m), dtype=np.uint32))
                w.append(np.zeros((m, 8), dtype=np.uint8))
                w[-1][:, :HASH] = np.frombuffer(raw, np.uint8, HASH * m, 17 * nd + 8 * m).reshape(m, HASH)
                n += nd
        if not n:
            return
        table, rank = np.unique(np.concatenate(docs), axis=0, return_inverse=True)  # in the order of documents
        where = rank.ravel()[np.concatenate(at)] << 32 | np.concatenate(place).astype(np.int64)
        w = np.concatenate(w).view("<u8").ravel()
        late = np.unique(where[_late(w, where)])
        if len(late):
            yield from _cuts(late, table, run_words).to_batches(max_chunksize=10_000)

    return of


def later_copies(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """d (doc_id), t (text key), cut: from and to, by number of word, of runs that later copies cover; they may overlap. Documents that lose nothing are left out."""
    parts = partitions(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("d"), text_key().alias("t"), F.col("text").alias("x"))
    sent = own.mapInArrow(_pack(parts, gram_words, run_words), "p int, body binary").repartitionById(parts, F.col("p"))
    return sent.mapInArrow(_later(run_words), "d long, t long, cut array<int>").groupBy("d", "t").agg(F.flatten(F.collect_list("cut")).alias("cut"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: str, cut: list[int]) -> tuple[str, list[int]]:
    """The text without the words, and the numbers of the lines that go whole."""
    runs = np.array(cut, dtype=np.int64).reshape(-1, 2)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw.split())
    step = np.bincount(runs[:, 0], minlength=n + 1) - np.bincount(runs[:, 1], minlength=n + 1)
    out = np.cumsum(step)[:n] > 0
    lines, gone, at = [], [], 0
    for i, line in enumerate(raw.split(b"\n")):
        m = len(line.split())
        off = out[at : at + m]
        at += m
        if m and off.all():
            gone.append(i)
            continue
        if off.any():
            spans = [x.span() for x in _WORD.finditer(line)]
            kept, end = [], 0  # end: of what is dealt with
            for k, (a, b) in enumerate(spans):
                if off[k]:
                    # The blanks behind a deleted word go with it, at the line's end those before it.
                    if k + 1 < m:
                        kept.append(line[end:a])
                        end = spans[k + 1][0]
                    else:
                        kept.append(line[end:a])
                        end = b
            whole = b"".join([*kept, line[end:]])
            line = whole.rstrip() if off[-1] else whole
        lines.append(line)
    return b"\n".join(lines).decode("utf-8", "surrogatepass"), gone


def _cut(text: str | None, cut: list[int] | None) -> tuple:
    return (text, []) if cut is None or text is None else cut_words(text, cut)


def repeated_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """d (doc_id), t (text key), gone: the sorted numbers, from 0, of a document's lines that are later copies as a whole. Documents that lose none are left out."""
    out = dedup_lines(docs.select("doc_id", "text", text_key().alias("t")), gram_words, run_words)
    return out.where("size(gone) > 0").select(F.col("row.doc_id").cast("long").alias("d"), "row.t", "gone").distinct()


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the words gone from text; gone: the lines that went whole. Other columns and clashing names stay as they are."""
    cuts = later_copies(docs, gram_words, run_words)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d0"), text_key().alias("t0"))
    both = rows.join(cuts, rows.d0.eqNullSafe(cuts.d) & (rows.t0 == cuts.t), "left")
    cutting = F.udf(_cut, "text string, gone array<int>", useArrow=True)
    both = both.select("row", cutting(F.when(F.col("cut").isNotNull(), F.col("row.text")), F.col("cut")).alias("left"), F.col("cut").isNull().alias("whole"))
    text = F.when(F.col("whole"), F.col("row.text")).otherwise(F.col("left.text"))
    return both.select(F.col("row").withField("text", text).alias("row"), F.coalesce("left.gone", F.array().cast("array<int>")).alias("gone"))


def op1_line_dedup(spark, sf_dir):
    """doc_id, n_lines, gone (lines deleted), n_gone, chars_left and crc32 of what is left of the text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = dedup_lines(n)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return out.select("row.doc_id", "row.n_lines", "gone", F.size("gone").cast("long").alias("n_gone"), F.length(text).cast("long").alias("chars_left"), F.crc32(text.cast("binary")).alias("text_crc32"))
