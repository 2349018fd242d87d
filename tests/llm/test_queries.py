"""Whole results of queries against a walk of single keys and of single nodes."""

import math

import pytest
from pyspark.sql import functions as F

from pressroom.llm import quality_rules, sharding
from pressroom.llm.docstats import RATIOS, counts, ratios

from .helpers import SF


def test_query_shards_are_a_walk_of_keys(spark):
    """Rounds of a walk round the ring with the documents' own keys: each takes the next point of a shard with room, a shard with too many takes each arc's part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.hex(F.xxhash64(text, F.col("text").isNull())).alias("text"))
    keyed = docs.select("doc_id", F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull()).alias("h")).collect()
    keys = sorted(((r.h % (1 << 64)) >> 48, r.h, r.doc_id) for r in keyed)
    at, who = (x.tolist() for x in sharding.ring(24))
    room = sharding.capacities(len(keys), 24).tolist()
    arcs: dict[int, list[int]] = {}
    for a, _, d in keys:
        arcs.setdefault(a, []).append(d)
    first = lambda a: next((i for i, x in enumerate(at) if x >= a), 0)
    where, shard = {a: first(a) for a in arcs}, {}
    while any(arcs.values()):
        want: dict[int, list[int]] = {}
        for a in sorted(a for a in arcs if arcs[a]):
            while room[who[where[a]]] == 0:
                where[a] = (where[a] + 1) % len(at)
            want.setdefault(who[where[a]], []).append(a)
        for s, own in sorted(want.items()):
            total = sum(len(arcs[a]) for a in own)
            take = {a: len(arcs[a]) for a in own}
            if total > room[s]:
                take = {a: len(arcs[a]) * room[s] // total for a in own}
                for a in own:
                    if sum(take.values()) < room[s] and take[a] < len(arcs[a]):
                        take[a] += 1
            for a in own:
                for d in arcs[a][: take[a]]:
                    shard[d] = s
                arcs[a] = arcs[a][take[a] :]
            room[s] -= sum(take.values())
    assert {r.doc_id: r["shard"] for r in sharding.op3_sharding(spark, SF).collect()} == shard


def test_query_scores_are_a_walk_of_nodes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trees = quality_rules.fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        c, words = counts(text)
        x, total = ratios(text, c), trees.start
        assert len(x) == len(RATIOS)
        for r in trees.root:
            at = int(r)
            while trees.feature[at] >= 0:
                at = int(trees.left[at] if x[trees.feature[at]] <= trees.cut[at] else trees.right[at])
            total += trees.value[at]
        score = 1 / (1 + math.exp(-total))
        failed = len(words) < 10 or 100 * c["n_repeat_words"] > 20 * len(words)
        assert got[d].score == pytest.approx(score, abs=1e-12) and got[d].base_failed == failed and got[d].kept == (not failed and score >= quality_rules.THRESHOLD)
