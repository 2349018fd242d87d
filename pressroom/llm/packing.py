"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length L belongs to class k = capacity // L: k pieces of its class fit into a sequence, so its slot is capacity // k. A
document is cut at the capacity, and what remains is kept whole if its slot has `slack` of its length to spare at most; else a piece of the
next smaller slot, capacity // (k + 1), is cut off, which fills that slot, and the rest goes on. Every task fills the sequences
of each class with exactly k pieces, on its own. What tasks have left (fewer than k pieces of each class) meets in groups of about `GROUP`
tokens, which fill sequences by the same rule; the last remainders of a group are laid end to end and cut, at the capacity and,
for the last, at powers of two, which need no padding. So tokens cross the network only for remainders: at most one sequence a class and task.

Whole texts are tokenised, in parts (the tokenizer drops blanks and parts words by kinds of characters, so ids are those of the text), and
parts are remembered. Null and empty texts have the end id only. A null doc_id stays null; rows equal in doc_id, or wholly, are documents each, with pieces of
their own. Very long texts are cut like others. Equal lengths take places in the order of the rows. An empty table gives an empty one. Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read

CAPACITY, END = 4096, 2
#: The part of its length by which a piece's slot may exceed it.
SLACK = 1 / 128
#: Tokens of a group of remainders, on average.
GROUP = 1 << 22
#: Parts of words that a worker remembers; bytes of the texts that it tokenises together; tokens of a batch that it sends on.
WORDS, BYTES, BATCH = 1_000_000, 1 << 23, 1 << 20
SHAPE = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Characters whose lower case and kind are the same everywhere: ASCII and the letters of Latin-1. No text of these has anything to compose.
_PLAIN = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*")
#: How the tokenizer parts a text in lower case, for these characters.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")


#: How the tokenizer marks the last id of a word in its vocabulary.
_LAST = "</w>"


class WordIds:
    """Ids of texts, of which the ids of parts are remembered.

    A word of plain characters is parted as the tokenizer parts it; parts that aren't remembered are tokenised together, as one text, whose
    ids end where the vocabulary marks the end of a word. Any other word, or one that may hold a special token, is tokenised as it is."""

    def __init__(self, path: str, bound: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[k for x, k in vocabulary.items() if x.endswith(_LAST)]] = True
        self.seen: dict[str, bytes] = {}
        self.bound = bound

    def _parts(self, word: str) -> list[str]:
        return _PARTS.findall(word.lower()) if _PLAIN.fullmatch(word) and "<|" not in word else [word]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        plain = [x for x in new if _PLAIN.fullmatch(x) and "<|" not in x]
        for k in range(0, len(plain), 4096):
            own = plain[k : k + 4096]
            ids = self._encode(" ".join(own))
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(own) or ends[-1] != len(ids):
                raise ValueError("the tokenizer doesn't mark the last id of a word")
            for x, i, j in zip(own, [0, *ends[:-1]], ends, strict=True):
                self.seen[x] = ids[i:j].tobytes()
        for x in set(new).difference(plain):
            self.seen[x] = self._encode(x).tobytes()

    def of(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The texts' ids, each with the end id; no nulls. Each word of the lot is looked up once."""
        words = pc.ascii_split_whitespace(texts)
        known = words.flatten().dictionary_encode()
        parts = [self._parts(x) for x in known.dictionary.to_pylist()]
        if len(self.seen) > self.bound:
            self.seen.clear()
        self._learn(sorted({y for x in parts for y in x if y not in self.seen}))
        own = [self.seen[x[0]] if len(x) == 1 else b"".join(map(self.seen.__getitem__, x)) for x in parts]
        size = np.array([len(x) for x in own], dtype=np.int64) // 4
        pool, first, which = np.frombuffer(b"".join(own), dtype="<u4"), np.cumsum(size) - size, known.indices.to_numpy()
        length = size[which]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = pool[np.repeat(first[which] - upto[:-1], length) + np.arange(upto[-1])]
        ends = upto[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [np.append(ids[i:j], np.uint32(end)) for i, j in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One a worker, which keeps what it remembers from task to task."""
    return WordIds(path)


@lru_cache(1 << 16)
def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> tuple[int, ...]:
    """Lengths of the pieces of a document of up to `capacity` tokens."""
    out = []
    while length:
        k = capacity // length
        if capacity // k - length <= slack * length:
            out.append(length)
            break
        out.append(capacity // (k + 1))
        length -= out[-1]
    return tuple(out)


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


def pieces(doc_id: int | None, ids: np.ndarray, capacity: int, slack: float) -> Iterator[Piece]:
    n, at = len(ids), 0
    for size in chain([capacity] * (n // capacity), cuts(n % capacity, capacity, slack)):
        yield Piece(doc_id, at, ids[at : at + size], n)
        at += size


class Bins:
    """Open sequences, one a class. put gives the sequence that a piece has filled."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, {}

    def put(self, p: Piece) -> list[Piece] | None:
        k = self.capacity // len(p.ids)
        own = self.open.setdefault(k, [])
        own.append(p)
        return self.open.pop(k) if len(own) == k else None

    def rest(self) -> list[Piece]:
        return [p for k in sorted(self.open) for p in self.open[k]]


def close(rest: list[Piece], capacity: int) -> Iterator[list[Piece]]:
    """Pieces end to end, cut to sequences of the capacity, and at the end of powers of two."""
    left, room, own = sum(len(p.ids) for p in rest), 0, []
    for p in rest:
        at = 0
        while at < len(p.ids):
            if not room:
                room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
            n = min(room, len(p.ids) - at)
            own.append(Piece(p.doc_id, p.start + at, p.ids[at : at + n], p.doc_tokens))
            at, room, left = at + n, room - n, left - n
            if not room:
                yield own
                own = []


class Rows:
    """Pieces of sequences, as a batch. Number -1 stands for no sequence."""

    def __init__(self):
        self.held: list[tuple[Piece, int, int]] = []
        self.tokens = 0

    def add(self, own: list[Piece], number: int) -> None:
        at = 0
        for p in own:
            self.held.append((p, number, at))
            at += len(p.ids)
        self.tokens += at

    def batch(self) -> pa.RecordBatch:
        ps, numbers, offsets = zip(*self.held, strict=True)
        raw = [p.ids.astype("<u4", copy=False).tobytes() for p in ps]
        number, offset = np.array(numbers), np.array(offsets)
        out = {"doc_id": pa.array([p.doc_id for p in ps], pa.int64()), "start": [p.start for p in ps], "length": [len(x) // 4 for x in raw], "ids": pa.array(raw, pa.binary()), "ids_crc32": [zlib.crc32(x) for x in raw], "doc_tokens": [p.doc_tokens for p in ps]}
        out |= {"sequence_id": pa.array(number, pa.int64(), mask=number < 0), "offset": pa.array(offset, pa.int64(), mask=number < 0)}
        self.held, self.tokens = [], 0
        return pa.RecordBatch.from_pydict(out)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts, in lots of about BYTES bytes at most."""
    for b in batches:
        docs, texts = b.column(0).to_pylist(), pc.fill_null(b.column(1), "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(docs):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES)))
            yield docs[at:to], texts[at:to]
            at = to


def _fill(path: str, capacity: int, end: int, slack: float) -> Callable:
    """Documents to pieces in the sequences that the task fills, then, without a sequence, to those left over."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, bins, out = word_ids(path), Bins(capacity), Rows()
        number = TaskContext.get().partitionId() << 32
        for docs, texts in _lots(batches):
            for d, ids in zip(docs, words.of(texts, end), strict=True):
                for p in pieces(d, ids, capacity, slack):
                    if own := bins.put(p):
                        out.add(own, number)
                        number += 1
                        if out.tokens >= BATCH:
                            yield out.batch()
        out.add(bins.rest(), -1)
        if out.held:
            yield out.batch()

    return of


def _regroup(capacity: int) -> Callable:
    """The remainders of a group, in an order of their own, to sequences numbered from 2^62 on."""

    def of(group: pa.Table) -> pa.Table:
        rows = group.sort_by([(c, "ascending") for c in ("worker", "doc_id", "start", "ids_crc32")])
        bins, out, number = Bins(capacity), Rows(), 1 << 62 | group["g"][0].as_py() << 32
        columns = (rows[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))
        full = []
        for d, start, ids, tokens in zip(*columns, strict=True):
            if own := bins.put(Piece(d, start, np.frombuffer(ids, "<u4"), tokens)):
                full.append(own)
        for i, own in enumerate(chain(full, close(bins.rest(), capacity))):
            out.add(own, number + i)
        return pa.Table.from_batches([out.batch()])

    return of


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, slack: float = SLACK) -> DataFrame:
    """SHAPE: the documents' pieces with their ids (unsigned 32-bit numbers, little-endian), and their places in sequences. path: a tokenizer's file, on every executor."""
    first = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fill(path, capacity, end, slack), SHAPE).withColumn("worker", F.spark_partition_id()))
    left = first.where("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // GROUP))
    regrouped = left.withColumn("g", F.pmod(F.hash("worker"), F.lit(groups)).cast("long")).groupBy("g").applyInArrow(_regroup(capacity), SHAPE)
    return first.where("sequence_id is not null").drop("worker").unionByName(regrouped)


def op11_packing(spark, sf_dir):
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
