"""The fresh pool: what was shown, and clicked, just before a time.

An event at e is in [t - W, t) for t in (e, e + W]; a click is seen in [t - W, t - lag) for t in (e + lag, e + W]. So each event steps
an article's counts up and down again, and between steps they are constant: segments (b, next]. A time meets just the
articles that are in its pool. Steps are cut at buckets as wide as the longest window, so that an event falls in two of them and no
group is a whole article's log. Times and segments meet by an equi-join on hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACKFILL_HOURS, CLICK_LAG_MINUTES, MICROS_HOUR, MICROS_MINUTE, POOL_HOURS
from .stats import popularity


def segments(displays: DataFrame, hours: float = POOL_HOURS, backfill: float = BACKFILL_HOURS, lag: float = CLICK_LAG_MINUTES) -> DataFrame:
    """displays: art, t, click. Returns art, b, e, shown, shown_back, clicked: the counts for times in (b, e]."""
    w, back, late = int(hours * MICROS_HOUR), int(backfill * MICROS_HOUR), int(lag * MICROS_MINUTE)
    step = lambda at, d, o, c: F.struct((F.col("t") + at).alias("b"), F.lit(d).alias("d"), F.lit(o).alias("o"), c.cast("int").alias("c"))
    zero, click = F.lit(0), F.col("click")
    steps = displays.select("art", "t", F.explode(F.array(step(0, 1, 1, zero), step(w, -1, 0, zero), step(back, 0, -1, zero), step(late, 0, 0, click), step(w, 0, 0, -click))).alias("s"))
    first = F.floor(F.col("t") / back).cast("bigint")
    k = steps.select("art", "s", F.explode(F.array(first, first + 1)).alias("k"))
    k = k.select("art", "k", F.greatest(F.col("s.b"), F.col("k") * back - 1).alias("b"), "s.d", "s.o", "s.c").where(F.col("b") < (F.col("k") + 1) * back - 1)
    k = k.groupBy("art", "k", "b").agg(F.sum("d").alias("d"), F.sum("o").alias("o"), F.sum("c").alias("c"))
    own = Window.partitionBy("art", "k").orderBy("b")
    run = lambda c: F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0))
    out = k.select("art", "b", F.coalesce(F.lead("b").over(own), (F.col("k") + 1) * back - 1).alias("e"), run("d").alias("shown"), run("o").alias("shown_back"), run("c").alias("clicked"))
    return out.where("shown_back > 0 or shown > 0")


def _met(segs: DataFrame, times: DataFrame, width: int) -> DataFrame:
    by = F.sequence(F.floor((F.col("b") + 1) / width).cast("bigint"), F.floor(F.col("e") / width).cast("bigint"))
    cut = segs.select("*", F.explode(by).alias("h"))
    return times.select("t", F.floor(F.col("t") / width).cast("bigint").alias("h")).join(cut, "h").where("t > b and t <= e")


def at_times(segs: DataFrame, times: DataFrame, width: int = MICROS_HOUR) -> DataFrame:
    """times: t, distinct. Returns t, art, shown, shown_back, clicked."""
    return _met(segs, times, width).select("t", "art", "shown", "shown_back", "clicked")


def lists_at(segs: DataFrame, times: DataFrame, width: int = MICROS_HOUR) -> DataFrame:
    """at_times as one row a time: t, pool, structs of all that segs has but b and e. Times of an hour lie together, so grouping shuffles nothing."""
    return _met(segs, times, width).groupBy("h", "t").agg(F.collect_list(F.struct(*(c for c in segs.columns if c not in ("b", "e")))).alias("pool")).select("t", "pool")


def ranked(pool: DataFrame, k: int) -> DataFrame:
    """t, art, rank, score, backfill: the pool by lagged clicks, displays and article; then, to fill k, what was only shown in the longer window, by displays, with score 0."""
    tier = (F.col("shown") == 0).cast("int")
    # In the first tier clicks, then displays; in the second displays in the longer window.
    w = Window.partitionBy("t").orderBy(tier, F.desc(F.when(tier == 0, F.col("clicked")).otherwise(F.col("shown_back"))), F.desc("shown"), "art")
    out = pool.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return out.select("t", "art", "rank", F.when(F.col("shown") > 0, F.col("clicked").cast("double")).otherwise(0.0).alias("score"), (F.col("shown") == 0).alias("backfill"))


def filled(lists: DataFrame, displays: DataFrame, k: int, key: str = "q") -> DataFrame:
    """lists: key, list (structs of art, rank, score, in the order of rank; null: found nothing). Fills each up to k with popular articles that aren't there yet, score 0.
    k + k popular articles are enough for any query. All happens inside the row."""
    top = popularity(displays, top=2 * k).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "art"))), lambda x: x["art"]).alias("_top"))
    own = F.coalesce("list", F.array().cast(lists.schema["list"].dataType))
    n = F.size(own)
    fill = F.transform(F.slice(F.array_except("_top", F.transform(own, lambda x: x["art"])), 1, k - n), lambda x, i: F.struct(x.alias("art"), (n + i + 1).cast("bigint").alias("rank"), F.lit(0.0).alias("score")))
    return lists.crossJoin(F.broadcast(top)).select(key, F.when(n < k, F.concat(own, fill)).otherwise(own).alias("list"))


def padded(found: DataFrame, queries: DataFrame, displays: DataFrame, k: int) -> DataFrame:
    """found: q, art, rank, score. Its lists filled, as rows; a query that found nothing gets popular articles only, with used_fallback."""
    own = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "art", "score"))).alias("s"))
    item = lambda x: F.struct(x["art"].alias("art"), x["rank"].cast("bigint").alias("rank"), x["score"].alias("score"))
    lists = queries.select("q").join(own.select("q", F.transform("s", item).alias("list")), "q", "left").withColumn("key", F.struct("q", F.col("list").isNull().alias("none")))
    return filled(lists, displays, k, "key").select("key.q", F.inline("list"), F.col("key.none").alias("used_fallback"))


def wide(long: DataFrame, *flags: str) -> DataFrame:
    """q, candidates, scores (float), in the order of rank."""
    s = F.sort_array(F.collect_list(F.struct("rank", "art", F.col("score").cast("float").alias("score"))))
    return long.groupBy("q").agg(s.alias("s"), *(F.max(f).alias(f) for f in flags)).select("q", F.transform("s", lambda x: x["art"]).alias("candidates"), F.transform("s", lambda x: x["score"]).alias("scores"), *flags)


def long(wide_: DataFrame) -> DataFrame:
    """q, art, rank (from 1), score."""
    return wide_.select("q", F.posexplode(F.arrays_zip("candidates", "scores")).alias("p", "c")).select("q", F.col("c.candidates").alias("art"), (F.col("p") + 1).cast("bigint").alias("rank"), F.col("c.scores").alias("score"))
