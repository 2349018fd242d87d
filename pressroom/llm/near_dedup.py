"""MinHash near-dedup by a multi-index Hamming join.

A document's set of shingle hashes gives SYMBOLS MinHash values, each cut to 16 bits. Two signatures are near if they differ in
DISTANCE symbols or fewer. They are cut into CHUNKS chunks; by the pigeonhole principle a near pair has a chunk in which
it differs in one symbol at most. So each chunk is indexed once for each of its symbols left out, which enumerates the
allowed error: every near pair meets under a key. At the link threshold itself a pair isn't near in 3.3 of 10**6 cases (0.8) or
1.3 of 10**8 (0.85), and then it may still meet.

Under a key each document is tied to the least one, its head, not to all, if the two signatures agree in LOOSE symbols at all; the
components of these ties are families. A key with a member so unlike its head is looked at again: by the triangle inequality all that
is near to a member within LOOSE_DISTANCE - DISTANCE of the head has been tied to the head, so the other members alone are left, and
those are compared by their signatures, in blocks of SIGNATURES by SIGNATURES. So any two near documents are in one family, without
exception (tests, against all pairs). Within a family all pairs are confirmed on full sets, in blocks
of BLOCK by BLOCK documents, each block pair a task's work of bounded size; a pair that confirmed links have joined already
is skipped, and a task reports a forest of links. The components of the links are the classes.

Documents with equal sets are one node throughout; copies are never paired. Documents without words (or text) are linked
with nothing. Null doc_ids are passed over for the least doc_id of a class. Rows equal in doc_id and text are one document: they have
one class, and drop_near_duplicates keeps one of them. Very long texts are hashed whole. An empty table gives an empty table. doc_id
is a number; other columns may have any names and types, and aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, lower_ascii, materialize, mix, partitions, read, shingle_hashes, small_or_same, text_key

WORDS, PERCENT = 5, 80
SYMBOLS, CHUNKS = 48, 12
WIDTH = SYMBOLS // CHUNKS
DISTANCE = 2 * CHUNKS - 1
LOOSE, BLOCK, SIGNATURES = 14, 128, 512
LOOSE_DISTANCE = SYMBOLS - LOOSE

_ODD = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, SYMBOLS + 1001, dtype=np.uint64))


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each of SYMBOLS functions over a set's hashes."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 1024):
        least = np.minimum(least, (_ODD[:, None] * s[None, k : k + 1024] + _ADD[:, None]).min(1))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Signatures by row to their SYMBOLS keys: chunk, place left out, and the chunk's other symbols."""
    c = sig.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = []
    for skip in range(WIDTH):
        key = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(skip))[None] + np.zeros((len(c), 1), dtype=np.uint64)
        for k in range(WIDTH):
            if k != skip:
                key = (key << np.uint64(16)) | c[:, :, k]
        out.append(key)
    return np.concatenate(out, 1).view(np.int64)


def _sets(n: int):
    """doc_id, text key, text to doc_id, text key, node, size, signature."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for b in batches:
            nodes, sizes, sigs = [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_hashes(hashes(lower_ascii(t.encode("utf-8", "surrogatepass")).split()), n) if t else ()
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["d", "t", "node", "n", "sig"])

    return of


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = chunk_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS))
        offsets = np.arange(0, keys.size + 1, SYMBOLS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, keys.ravel())], ["node", "keys"])


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their signatures to a, b, and, if they agree in less than LOOSE symbols, the keys they share and a's signature."""
    for b in batches:
        x, y = _symbols(b.column(2)), _symbols(b.column(3))
        loose = (x == y).sum(1) >= LOOSE
        keys: list[np.ndarray | None] = [None] * b.num_rows
        for i, kx, ky in zip(np.flatnonzero(~loose), chunk_keys(x[~loose]), chunk_keys(y[~loose]), strict=True):
            keys[i] = kx[kx == ky]
        heads = [None if k is None else h for k, h in zip(keys, b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(heads, pa.binary())], ["a", "b", "keys", "sa"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, the signatures of the node and of the key's head to those that may be near to one that isn't tied to the head."""
    for b in batches:
        left = pa.array((_symbols(b.column(2)) != _symbols(b.column(3))).sum(1) > LOOSE_DISTANCE - DISTANCE)
        yield pa.RecordBatch.from_arrays([b.column(k).filter(left) for k in range(3)], ["root", "node", "set"])


def linked(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A forest of the links among sets of distinct numbers; side: compare only those on different sides."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if (side is None or side[0] != side[1]) and 100 * both >= percent * (size.sum() - both) else []
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int8)
    group, out = np.arange(m), []
    for i in range(m - 1):
        rest = slice(i + 1, m)
        want = (group[rest] != group[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
        if side is not None:
            want &= side[rest] != side[i]
        if not want.any():
            continue
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = 1
        at = np.flatnonzero(want) + i + 1
        if len(at) * 4 < m - i:
            both = np.array([mark[codes[starts[j] : starts[j + 1]]].sum(dtype=np.int64) for j in at])
        else:
            both = np.add.reduceat(mark[codes[starts[i + 1] :]], starts[i + 1 : m] - starts[i + 1], dtype=np.int64)[at - i - 1]
        mark[own] = 0
        for j in at[100 * both >= percent * (size[at] + size[i] - both)]:
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def near_signatures(x: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """A forest of the pairs of signatures within DISTANCE; side: as in `linked`."""
    group, out = np.arange(len(x)), []
    for i in range(len(x) - 1):
        want = ((x[i + 1 :] != x[i]).sum(1) <= DISTANCE) & (group[i + 1 :] != group[i])
        if side is not None:
            want &= side[i + 1 :] != side[i]
        for j in np.flatnonzero(want) + i + 1:
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that the texts or sets of thousands aren't held as objects at once."""
    for b in batches:
        yield from (b.slice(k, rows) for k in range(0, len(b), rows))


def _in_blocks(links: Callable):
    """Rows in the order of (root, b1, b2) to the pairs that links(payloads, side) finds. A group ends where the next begins; it holds two blocks at most."""

    def pairs(rows: list) -> tuple[list[bytes], list[bytes]]:
        own = {r[0]: r for r in rows}  # rows equal in doc_id and text come more than once
        rows = [own[k] for k in sorted(own)]
        if len(rows) < 2:
            return [], []
        side = None if rows[0][3] == rows[0][4] else np.array([r[2] for r in rows])
        found = links([r[1] for r in rows], side)
        return [rows[i][0] for i, _ in found], [rows[j][0] for _, j in found]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, a, b = None, [], [], []
        for batch in _sliced(batches):
            cols = [c.to_pylist() for c in batch.columns]  # root, b1, b2, block, node, set
            for root, b1, b2, block, node, s in zip(*cols, strict=True):
                if (root, b1, b2) != key:
                    for x, y in zip((a, b), pairs(held), strict=True):
                        x += y
                    key, held = (root, b1, b2), []
                held.append((node, s, block, b1, b2))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a, b = [], []
        a, b = pairs(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return of


def _compared(sets: DataFrame, links: Callable) -> DataFrame:
    """root, blocks, node, set to a, b: what `links` finds among the nodes of a root, a block against a block at a time."""
    own = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("b1"), F.greatest("block", x).alias("b2")))
    pairs = own.select("root", F.explode(others).alias("p"), "block", "node", "set").select("root", "p.b1", "p.b2", "block", "node", "set")
    pairs = pairs.repartition(partitions(sets.sparkSession), "root", "b1", "b2").sortWithinPartitions("root", "b1", "b2")
    return pairs.mapInArrow(_in_blocks(links), "a binary, b binary")


def _blocks(members: DataFrame, size: int) -> DataFrame:
    return materialize(members.groupBy("root").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")))


def families(nodes: DataFrame) -> DataFrame:
    """node, sig to node, root: any two nodes whose signatures are within DISTANCE have the same root. Nodes near to none may lack a row."""
    from .components import components

    spark, sig = nodes.sparkSession, nodes.select("node", "sig")
    keys = sig.mapInArrow(_keys, "node binary, keys array<long>").select(F.explode("keys").alias("key"), "node")
    dealt = keys.repartition(partitions(spark), "key")  # one exchange, for the aggregation and the join
    heads = dealt.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1").select("key", "a")
    ties = materialize(dealt.join(heads, "key").where("node != a").select("a", F.col("node").alias("b")).distinct())
    ties = ties.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    ties = materialize(ties.select("a", "b", "sa", "sb").mapInArrow(_ties, "a binary, b binary, keys array<long>, sa binary"))
    tied = ties.where("keys is null").select("a", "b")
    # Of the nodes that name a key here the least is its head, if the key has a member unlike its head; if it has none, it needs no second look.
    again = ties.where("keys is not null").select(F.explode("keys").alias("key"), "a", "sa").groupBy("key").agg(F.min(F.struct("a", "sa")).alias("h"))
    again = materialize(again.select("key", "h.sa"))
    if not again.isEmpty():
        met = materialize(keys.join(small_or_same(again.select("key")), "key"))
        left = met.join(sig, "node").join(small_or_same(again), "key").select("key", "node", "sig", "sa")
        left = materialize(left.mapInArrow(_left, "root long, node binary, set binary"))
        blocks = _blocks(left, SIGNATURES)
        found = _compared(left.join(small_or_same(blocks), "root"), lambda sigs, side: near_signatures(np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(-1, SYMBOLS), side))
        tied = tied.unionByName(found)
    return components(tied)


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """d (doc_id), t (text key), n (shingles), component (the least doc_id that can be reached over links of percent/100 Jaccard)."""
    from .components import components

    own = docs.select(F.col("doc_id").cast("long").alias("d"), text_key().alias("t"), F.col("text").alias("x"))
    rows = materialize(own.mapInArrow(_sets(n), "d long, t long, node binary, n long, sig binary"))
    least = F.min(F.struct(F.col("d").isNull().alias("z"), "d", "t"))  # of those with a doc_id, if there are any
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(least.alias("least"), F.first("sig").alias("sig")))
    family = materialize(families(nodes))
    blocks = _blocks(family, BLOCK)
    members = family.join(small_or_same(blocks), "root").join(nodes, "node")
    members = materialize(members.select("node", "root", "blocks", F.col("least.d").alias("d1"), F.col("least.t").alias("t1")))
    texts = own.join(small_or_same(members), own.d.eqNullSafe(F.col("d1")) & (own.t == F.col("t1"))).select("node", "root", "blocks", "x")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in _sliced(batches):
            sets = [shingle_hashes(hashes(lower_ascii(t.encode("utf-8", "surrogatepass")).split()), n).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], ["node", "root", "blocks", "set"])

    sets = texts.mapInArrow(full, "node binary, root binary, blocks int, set binary")
    links = _compared(sets, lambda found, side: linked([np.frombuffer(s, dtype=np.uint64) for s in found], side, percent))
    classes = materialize(components(materialize(links)))
    first = materialize(classes.join(nodes, "node").groupBy("root").agg(F.min("least").alias("first")))
    found = classes.join(small_or_same(first), "root").select("node", "first")
    found = materialize(nodes.select("node", "least").join(found, "node", "left").select("node", F.coalesce("first", "least").alias("first")))
    out = ("d", "t", "n", "first")
    # Documents without words stay out of the join: nulls would be one key.
    alone = rows.where("node is null").select("d", "t", "n", F.lit(None).cast(found.schema["first"].dataType).alias("first"))
    both = rows.where("node is not null").join(small_or_same(found), "node").select(*out).unionByName(alone)
    return both.select(*out, F.coalesce("first.d", "d").alias("component"))


def drop_near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each class, that with the least doc_id (of texts equal in doc_id, that with the least key), with its own columns;
    and all documents without words. Of rows equal in doc_id and text one stays, the least by a hash of its columns."""
    marked = near_duplicates(docs, n, percent).where("first is not null").groupBy("d", "t").agg(F.count("*").alias("c"), F.first("first").alias("first"))
    one = F.col("d").eqNullSafe(F.col("first.d")) & (F.col("t") == F.col("first.t"))
    marked = materialize(marked.select(F.col("d").alias("d1"), F.col("t").alias("t1"), one.alias("one"), "c").where("not one or c > 1"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d0"), text_key().alias("t0"))
    same = F.col("d0").eqNullSafe(F.col("d1")) & (F.col("t0") == F.col("t1"))
    often = materialize(marked.where("one"))
    repeated = rows.join(small_or_same(often), same, "left_semi").groupBy("d0", "t0").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.join(small_or_same(marked), same, "left_anti").select("row.*").unionByName(repeated.select("row.*"))


def op9_near_dedup(spark, sf_dir):
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=85)
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("d").eqNullSafe(F.col("component")).alias("kept"))
