"""First stages: each gives q, art, rank, score, used_fallback, k rows a query at most.

What used_fallback says differs: bm25 and semantic had no query or vector at all and took the popular list; popular had to draw on the
longer window; bm25_fresh had no query and ranked the pool by popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACKFILL_HOURS, CANDIDATES_K, CLICK_LAG_MINUTES, KEYWORDS, POOL_HOURS, QUERY_WINDOW
from ..functions.scalars import draw
from ..sources.shared import stored
from . import bm25 as index_
from . import pool, semantic


def _queries(histories, catalogue, index, method, window, keywords):
    return index_.query_terms(histories, catalogue, method, window, index, keywords)


def bm25(queries: DataFrame, histories: DataFrame, catalogue: DataFrame, displays: DataFrame, index: index_.Index, k: int = CANDIDATES_K, method: str = "tfidf_keywords", window: int | None = QUERY_WINDOW, keywords: int = KEYWORDS) -> DataFrame:
    """queries: q; histories: q, history. method "direct" is the older retriever."""
    lists, members = index_.lists_of_distinct(index, _queries(histories, catalogue, index, method, window, keywords), k)
    # Lists are filled once for all members; the popular list, for those that found nothing, is one more.
    found = stored(pool.filled(lists, displays, k, "rep"))
    none = queries.sparkSession.range(1).select(F.lit(None).cast(lists.schema["list"].dataType).alias("list"))
    popular_ = pool.filled(none.withColumn("q", F.lit(0)), displays, k).select("list")
    own = queries.select("q").join(members, "q", "left").join(found.select("rep"), "rep", "left_semi")
    others = queries.select("q").join(own.select("q"), "q", "left_anti")
    both = own.join(found, "rep").select("q", "list", F.lit(False).alias("used_fallback")).unionByName(others.crossJoin(F.broadcast(popular_)).select("q", "list", F.lit(True).alias("used_fallback")))
    return both.select("q", F.inline("list"), "used_fallback")


def semantic_(queries: DataFrame, histories: DataFrame, vectors: DataFrame, displays: DataFrame, k: int = CANDIDATES_K, method: str = "mean", window: int | None = None) -> DataFrame:
    """histories: q, history (vector ids). A user with a zero vector is padded like one without, but isn't flagged."""
    # A user's history is pooled, searched and filled in its own row: of k entries, none is shuffled.
    own = semantic.history_lists(queries.select("q").join(histories, "q", "left"), vectors, k, "art", method, window)
    lists = own.withColumn("key", F.struct("q", F.col("list").isNull().alias("none")))
    return pool.filled(lists, displays, k, "key").select("key.q", F.inline("list"), F.col("key.none").alias("used_fallback"))


def popular(points: DataFrame, displays: DataFrame, k: int = CANDIDATES_K, hours: float = POOL_HOURS, backfill: float = BACKFILL_HOURS, lag: float = CLICK_LAG_MINUTES) -> DataFrame:
    """points: q, t. Ranked once for each time."""
    ranked = pool.ranked(pool.at_times(pool.segments(displays, hours, backfill, lag), points.select("t").distinct()), k)
    out = points.join(ranked, "t")
    return out.select("q", "art", "rank", "score", F.max("backfill").over(Window.partitionBy("q")).alias("used_fallback"))


def bm25_fresh(points: DataFrame, histories: DataFrame, catalogue: DataFrame, displays: DataFrame, index: index_.Index, k: int = CANDIDATES_K, method: str = "tfidf_keywords", window: int | None = QUERY_WINDOW, keywords: int = KEYWORDS, hours: float = POOL_HOURS, seed: int = 0) -> DataFrame:
    """points: q, usr, t; histories: q (the user), history. The pool by the query's score, ties by a seeded draw, then what the longer window adds; without a query the pool by popularity."""
    codes = index_.coded(index)
    weights = index_.weights(_queries(histories, catalogue, index, method, window, keywords), codes).withColumnRenamed("q", "usr")
    segs = pool.segments(displays, hours).join(index_.texts(index, codes).withColumnRenamed("doc", "art"), "art", "left")
    pools = pool.lists_at(segs, points.select("t").distinct())
    # A point's pool stays in its row, where it is scored, ranked and cut: no pair of point and article is shuffled.
    rows = points.select("q", "usr", "t").join(weights, "usr", "left").join(pools, "t").crossJoin(F.broadcast(index.stats.select("avgdl")))
    own = F.col("_w").isNotNull()

    def scored(x):
        tier = (x["shown"] == 0).cast("int")
        s = F.when(tier == 1, 0.0).when(own, index_.pair_score(F.col("avgdl"), text=x["_t"], length=x["_len"])).otherwise(x["clicked"].cast("double"))
        tie = F.when(tier == 1, -x["shown_back"].cast("bigint")).when(own, draw(seed, F.col("q"), x["art"])).otherwise(-x["shown"].cast("bigint"))
        return F.struct(tier.alias("tier"), (0.0 - s).alias("s"), tie.alias("tie"), x["art"].alias("art"))

    best = rows.select("q", own.alias("own"), F.slice(F.sort_array(F.transform("pool", scored)), 1, k).alias("best"))
    out = best.select("q", "own", F.posexplode("best").alias("i", "x"))
    return out.select("q", F.col("x.art").alias("art"), (F.col("i") + 1).cast("bigint").alias("rank"), (0.0 - F.col("x.s")).alias("score"), (~F.col("own")).alias("used_fallback"))


GENERATORS = {"bm25": bm25, "semantic": semantic_, "popular": popular, "bm25_fresh": bm25_fresh}


def build(method: str, *args, **more) -> DataFrame:
    """The wide table of a method: q, candidates, scores, used_fallback."""
    if method not in GENERATORS:
        raise ValueError(method)
    return pool.wide(GENERATORS[method](*args, **more), "used_fallback")
