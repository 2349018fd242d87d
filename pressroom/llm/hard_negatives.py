"""Hard negatives by branch and bound over ball trees.

Rows are dealt evenly to partitions, and each partition grows trees of `TREE` rows: a node is a ball (centre and radius) halved
along the line between two far points. The inner product of an anchor with any row of a ball lies within centre.a - r|a| and centre.a + r|a|. So
a node is passed over if it lies outside the score window, holds no row of a wanted label, or lies strictly beneath the k-th best
score so far (strictly: at the same score the smaller id wins). The trees are stored; blocks of anchors are broadcast beside them, in
passes of bounded size, and a task searches its trees one after the other, with k rows a query at most in the end. A window over
those gives the first k of all. First the positives are searched (same label), then, for each, the negatives in its window.

Scores are exact: entries are floor(scale * x), and products are added in doubles, which hold them exactly below 2^53; beyond that an error is raised.

Rows with a null id, a null label, a null or empty vector, or a null or non-finite entry take no part. Ties go by the smaller id. Rows
repeated under one id all take part as candidates, and are never their own anchor's positives; equal anchors count
once, unlike ones of one id are searched each for itself. An anchor without another row of its label, or whose positives' windows are empty, gives no rows, as does an empty table. Vectors
of unlike length raise an error. Texts and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, read
from .whitening import SCALE, quantised, vectors_of

#: Rows of a tree and of a leaf, at most.
TREE, LEAF = 2048, 32
#: Anchors of a block, on average; bytes of blocks that are broadcast at once.
BLOCK, SENT = 256, 1 << 25
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's must lie.
LOW, HIGH = 30, 90


class Tree(NamedTuple):
    """Rows in the order of the leaves; nodes: begin, end, left and right (-1: a leaf)."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    nodes: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def grow(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    order, points = np.arange(len(x)), x.astype(np.float64)
    nodes, centres, radii = [[0, len(x), -1, -1]], [], []
    for node in nodes:  # grows as it goes
        begin, end = node[:2]
        own = points[order[begin:end]]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        centres.append(centre)
        radii.append(away.max() * (1 + 1e-9))
        if end - begin <= leaf:
            continue
        one = own[away.argmax()]
        other = own[((own - one) ** 2).sum(1).argmax()]
        half = (end - begin) // 2
        order[begin:end] = order[begin:end][np.argpartition(own @ (other - one), half)]
        node[2:] = [len(nodes), len(nodes) + 1]
        nodes += [[begin, begin + half, -1, -1], [begin + half, end, -1, -1]]
    return Tree(ids[order], labels[order], x[order], np.array(nodes, dtype=np.int32), np.array(centres), np.array(radii))


class Anchors(NamedTuple):
    """Anchors (id, label, vector) and queries: number of the anchor, least and greatest score."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    who: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Best:
    """Each query's first k rows so far: score (-inf: none) and id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """number of the query, id and score."""
        query, rank = np.nonzero(np.isfinite(self.score))
        return query, self.ids[query, rank], self.score[query, rank].astype(np.int64)


def search(tree: Tree, anchors: Anchors, same: bool, found: Best) -> None:
    """Adds the tree's rows to found: those of the anchor's label (same), itself not, or of other labels."""
    x, a, who = tree.x.astype(np.float64), anchors.x.astype(np.float64), anchors.who
    if len(a) and np.abs(x).max() * np.abs(a).max() * x.shape[1] >= 2**53:
        raise ValueError("scores are too large to be exact")
    kinds, at = np.unique(tree.labels, return_inverse=True)
    counts = np.zeros((len(x) + 1, len(kinds)), dtype=np.int64)
    np.cumsum(np.eye(len(kinds), dtype=np.int64)[at], axis=0, out=counts[1:])
    inside = counts[tree.nodes[:, 1]] - counts[tree.nodes[:, 0]]  # rows of each label in each node
    place = np.minimum(np.searchsorted(kinds, anchors.labels), len(kinds) - 1)
    of_label = inside[:, place] * (kinds[place] == anchors.labels)  # a row a node, a column an anchor
    wanted = (of_label if same else (tree.nodes[:, 1] - tree.nodes[:, 0])[:, None] - of_label) > 0
    middle, width = tree.centres @ a.T, tree.radii[:, None] * np.sqrt((a * a).sum(1))
    slack = 1e-9 * (np.abs(middle) + width + 1)
    upper, lower = middle + width + slack, middle - width - slack
    best, ids = found.score, found.ids
    k = best.shape[1]
    stack = [(0, np.arange(len(who)))]
    while stack:
        node, live = stack.pop()
        mine = who[live]
        up = upper[node, mine]
        live = live[wanted[node, mine] & (up >= anchors.low[live]) & (up >= best[live, -1]) & (lower[node, mine] <= anchors.high[live])]
        if not len(live):
            continue
        begin, end, left, right = tree.nodes[node]
        if left >= 0:
            nearer = middle[left, who[live]].sum() >= middle[right, who[live]].sum()
            stack += [(right, live), (left, live)] if nearer else [(left, live), (right, live)]
            continue
        used, back = np.unique(who[live], return_inverse=True)
        score = (a[used] @ x[begin:end].T)[back]
        equal = tree.labels[None, begin:end] == anchors.labels[who[live], None]
        fits = (equal if same else ~equal) & (score >= anchors.low[live, None]) & (score <= anchors.high[live, None])
        if same:
            fits &= tree.ids[None, begin:end] != anchors.ids[who[live], None]
        score = np.hstack([best[live], np.where(fits, score, -np.inf)])
        row = np.hstack([ids[live], np.where(fits, tree.ids[None, begin:end], np.iinfo(np.int64).max)])
        first = np.lexsort((row, -score), axis=1)[:, :k]
        best[live], ids[live] = np.take_along_axis(score, first, 1), np.take_along_axis(row, first, 1)


_TREE = "ids binary, labels binary, x binary, nodes binary, centres binary, radii binary"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def tree(ids, labels, x) -> pa.RecordBatch:
        t = grow(ids, labels, x)
        raw = (t.ids.astype("<i8"), t.labels.astype("<i8"), t.x.astype("<i4"), t.nodes.astype("<i4"), t.centres.astype("<f8"), t.radii.astype("<f8"))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in raw], list(Tree._fields))

    for b in batches:
        if len(b):
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), vectors_of(b.column(2))))
        while sum(len(h[0]) for h in held) >= TREE:
            whole = [np.concatenate(v) for v in zip(*held, strict=True)]
            yield tree(*(v[:TREE] for v in whole))
            held = [tuple(v[TREE:] for v in whole)]
    if sum(len(h[0]) for h in held):
        yield tree(*(np.concatenate(v) for v in zip(*held, strict=True)))


def _tree(r: dict) -> Tree:
    ids = np.frombuffer(r["ids"], "<i8")
    x = np.frombuffer(r["x"], "<i4").reshape(len(ids), -1)
    return Tree(ids, np.frombuffer(r["labels"], "<i8"), x, np.frombuffer(r["nodes"], "<i4").reshape(-1, 4), np.frombuffer(r["centres"], "<f8").reshape(-1, x.shape[1]), np.frombuffer(r["radii"], "<f8"))


def _searched(same: bool, k: int, low: int, high: int):
    """Units of a tree and a block of anchors to anchor, positive (its id and score, or null) and the first rows of the task's trees for it. What a
    task has found in one tree bounds the search of the next."""

    def queries(block: list[dict]) -> tuple:
        x = np.array([q["x"] for q in block], dtype=np.int64)
        ids, labels, keys = (np.array([q[c] for q in block], dtype=np.int64) for c in ("id", "label", "key"))
        if same:
            asked = [(i, None, None) for i in range(len(block))]
            ends = np.full(len(block), -np.inf), np.full(len(block), np.inf)
        else:  # least and greatest score, as integers
            asked = [(i, p["id"], p["score"]) for i, q in enumerate(block) for p in q["positives"]]
            ends = np.array([-(-v[2] * low // 100) for v in asked]), np.array([v[2] * high // 100 for v in asked])
        return Anchors(ids, labels, x, np.array([v[0] for v in asked], dtype=np.int64), *ends), keys, asked, Best(len(asked), k)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple] = {}
        for b in batches:
            for r in b.to_pylist():
                tree = _tree(r)
                if r["block"] not in blocks:
                    blocks[r["block"]] = queries(r["anchors"])
                anchors, _, _, found = blocks[r["block"]]
                if anchors.x.shape[1] != tree.x.shape[1]:
                    raise ValueError("vectors differ in length")
                search(tree, anchors, same, found)
        for anchors, keys, asked, found in blocks.values():
            query, ids, score = found.rows()
            who = anchors.who[query]
            own = {"anchor": anchors.ids[who], "key": keys[who]} | {c: pa.array([asked[i][j] for i in query], pa.int64()) for j, c in ((1, "positive"), (2, "positive_score"))}
            yield pa.RecordBatch.from_pydict(own | {"id": ids, "score": score})

    return of


def _first(trees: DataFrame, anchors: DataFrame, blocks: int, d: int, same: bool, k: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The first k rows for each query of the anchors (id, label, x, block, positives), with their rank. A pass sends SENT bytes of anchors at most."""
    sent = max(1, SENT // (BLOCK * (8 * d + 256)))
    packed = anchors.groupBy("block").agg(F.collect_list(F.struct("id", "key", "label", "x", "positives")).alias("anchors"))
    shape = "anchor long, key long, positive long, positive_score long, id long, score long"
    passes = []
    for k0 in range(0, blocks, sent):
        own = F.broadcast(packed.where(F.col("block").between(k0, k0 + sent - 1)))
        units = trees.withColumn("block", F.explode(F.sequence(F.lit(k0), F.lit(min(blocks, k0 + sent) - 1)))).join(own, "block")
        passes.append(units.mapInArrow(_searched(same, k, low, high), shape))
    order = Window.partitionBy("anchor", "key", "positive", "positive_score").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, passes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows with id, label (longs) and x (integers). Anchors are the rows whose id `every` divides."""
    spark = rows.sparkSession
    rows = rows.select("id", "label", "x").repartition(partitions(spark))  # evenly, whatever the keys
    trees = materialize(rows.mapInArrow(_forest, _TREE))
    anchors = materialize(rows.where(F.col("id") % every == 0).distinct().withColumn("key", F.xxhash64("id", "label", "x")))
    n, one = anchors.count(), anchors.first()
    if one is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = -(-n // BLOCK)
    dealt = anchors.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    near = _first(trees, dealt.withColumn("positives", none), blocks, len(one["x"]), True, positives)
    near = materialize(near.groupBy("key").agg(F.collect_set(F.struct("id", "score")).alias("positives")))
    asked = dealt.join(near, "key")
    out = _first(trees, asked, blocks, len(one["x"]), False, negatives, low, high)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir):
    rows = quantised(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), scale=SCALE).where("row.vec_id is not null and row.label is not null")
    label = F.when(F.col("row.vec_id") % 7 == 0, (F.col("row.label") + 1) % 10).otherwise(F.col("row.label"))
    return mine(rows.select(F.col("row.vec_id").cast("long").alias("id"), label.cast("long").alias("label"), "x"))
