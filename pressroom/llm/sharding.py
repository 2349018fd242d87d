"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard has `vnodes` points on a ring of 2**16 arcs; a document's key (doc_id and text) has a place on it. Going clockwise
from the place, the first point gives its shard. A shard takes its capacity and no more; what overflows it goes on
clockwise to the next point of a shard with room. Capacities are (1 + slack) times the mean; with slack 0 they sum to the
number of rows and differ by one at most, so the shards do, too.

The walk needs only the number of rows in each arc: 2**16 counts at most, whatever the size of the data, which go to the
driver. Rows get their turn in their arc by hash; the arcs are even because keys are hashed, and a doc_id (or null) that
many rows share is spread by its text. Rows equal in both share an arc; an arc with many more rows than the mean is numbered
in lots, dealt by the rows' numbers, of which each takes up where the one before ends.

Nulls: a null doc_id hashes as such, a null text has no bytes and the checksum of the empty text. Empty and long texts, ties and
repeated rows are rows like others: each gets a slot of its own. An empty table gives an empty table. The document travels as one
struct, so its other columns may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, read

ARCS, VNODES = 1 << 16, 256
#: Rows of an arc, or times the mean of all arcs, up to which one task numbers them.
LOT, HOT = 20_000, 4


def ring(shards: int, vnodes: int = VNODES, arcs: int = ARCS) -> tuple[np.ndarray, np.ndarray]:
    """The points in ring order: arc and shard. A shard's points don't depend on the number of shards."""
    at = mix(np.arange(shards, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(vnodes, dtype=np.uint64)[None] + np.uint64(0xA5A5)).ravel()
    who = np.repeat(np.arange(shards), vnodes)
    order = np.lexsort((who, at))
    return (at[order] >> np.uint64(64 - int(arcs).bit_length() + 1)).astype(np.int64), who[order]


def capacities(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    if slack:
        return np.full(shards, int(np.ceil((1 + slack) * rows / shards)), dtype=np.int64)
    return rows // shards + (np.arange(shards) < rows % shards)


def assign(load: np.ndarray, shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[tuple[int, int, int, int]]:
    """(arc, first, end, shard): the turns first..end-1 of an arc go to the shard."""
    arcs, room = len(load), capacities(int(load.sum()), shards, slack)
    at, who = ring(shards, vnodes, arcs)
    where = np.searchsorted(at, np.arange(arcs)) % len(at)
    given, left, out = np.zeros(arcs, dtype=np.int64), load.astype(np.int64).copy(), []
    while left.any():
        ahead, nxt = np.empty(len(at), dtype=np.int64), -1  # from each point to the next whose shard has room
        for i in range(2 * len(at) - 1, -1, -1):
            if room[who[i % len(at)]] > 0:
                nxt = i % len(at)
            ahead[i % len(at)] = nxt
        where = ahead[where]
        shard = who[where]
        want = np.bincount(shard, weights=left, minlength=shards).astype(np.int64)
        for s in range(shards):
            mine = np.flatnonzero((shard == s) & (left > 0))
            if not len(mine):
                continue
            take = left[mine]
            if want[s] > room[s]:  # each arc's equal part; what rounding leaves goes to the first
                part = take * int(room[s]) // int(want[s])
                lack = int(room[s] - part.sum())
                more = np.flatnonzero(part < take)[:lack]
                part[more] += 1
                take = part
            room[s] -= take.sum()
            out += [(int(a), int(given[a]), int(given[a] + k), s) for a, k in zip(mine, take, strict=True) if k]
            given[mine] += take
            left[mine] -= take
    return out


def shard(docs: DataFrame, shards: int, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """row (the document as a struct), shard and slot: the place in the shard, from 0 without gaps."""
    spark = docs.sparkSession
    bits = ARCS.bit_length() - 1
    text = F.coalesce(F.col("text"), F.lit(""))
    copy = F.monotonically_increasing_id()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), text, F.col("text").isNull()).alias("h"), copy.alias("c"))
    # Rows equal in doc_id and text are alike, so which of them takes which turn doesn't show in the result.
    keyed = keyed.select("row", F.shiftrightunsigned("h", 64 - bits).cast("int").alias("arc"), "h", "c")
    load = np.zeros(ARCS, dtype=np.int64)
    for r in keyed.groupBy("arc").count().collect():  # ARCS rows at most
        load[r["arc"]] = r["count"]
    bound = max(LOT, HOT * int(load.sum()) // ARCS)
    hot = {int(a): int(-(-load[a] // bound)) for a in np.flatnonzero(load > bound)}
    lots: dict[int, list[int]] = {}
    lot = F.lit(0)
    if hot:  # ARCS / HOT arcs and ARCS * (1 + 1 / HOT) lots at most
        keyed = materialize(keyed)  # the rows' numbers are needed twice
        many = F.broadcast(spark.createDataFrame(list(hot.items()), "arc int, lots int"))
        lot = F.pmod(F.xxhash64("c"), F.coalesce("lots", F.lit(1))).cast("int")
        keyed = keyed.join(many, "arc", "left").withColumn("lot", lot)
        lots = {a: [0] * n for a, n in hot.items()}
        for r in keyed.where("lots is not null").groupBy("arc", "lot").count().collect():
            lots[r["arc"]][r["lot"]] = r["count"]
    else:
        keyed = keyed.withColumn("lot", lot)
    plan = assign(load, shards, vnodes, slack)
    slots, rows, base = np.zeros(shards, dtype=np.int64), [], 0
    for a, first, end, s in sorted(plan):
        rows.append((a, first, end, s, int(slots[s])))
        slots[s] += end - first
    spans: dict[int, list] = {}
    for a, *rest in rows:
        spans.setdefault(a, []).append(tuple(rest))
    before = {a: [0, *np.cumsum(n)[:-1].tolist()] for a, n in lots.items()}
    table = spark.createDataFrame([(a, x, before.get(a, [0])) for a, x in spans.items()], "arc int, spans array<struct<first:long,end:long,shard:int,base:long>>, before array<long>")
    in_lot = F.row_number().over(Window.partitionBy("arc", "lot").orderBy("h", "c")).cast("long") - 1
    # 2**16 arcs at most: a bound that doesn't depend on the data.
    out = keyed.withColumn("turn", in_lot).join(F.broadcast(table), "arc", "left").withColumn("turn", F.col("turn") + F.get("before", F.col("lot")))
    out = out.withColumn("span", F.element_at(F.filter("spans", lambda x: (x["first"] <= F.col("turn")) & (F.col("turn") < x["end"])), 1))
    return out.select("row", F.col("span.shard").alias("shard"), (F.col("span.base") + F.col("turn") - F.col("span.first")).alias("slot"))


def op3_sharding(spark, sf_dir, shards: int = 24):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.hex(F.xxhash64(text, F.col("text").isNull())).alias("text"))
    out = shard(docs, shards)
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
