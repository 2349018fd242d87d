"""Article statistics: popularity, and counts as of a time.

A statistic for a time sees only what was before it; rows at the same time don't see each other. A click is seen a
reporting lag after it was made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLICK_LAG_MINUTES, CTR_PRIOR, MICROS_MINUTE
from .ranks import ranked

LAG = CLICK_LAG_MINUTES * MICROS_MINUTE
#: Bucket of time within which a window frame runs: an article's log is cut into as many groups as it has buckets.
BUCKET = 86_400_000_000 * 30


def article_counts(displays: DataFrame) -> DataFrame:
    """art, display_count, click_count, from art and label."""
    return displays.groupBy("art").agg(F.count("*").alias("display_count"), F.sum("label").cast("bigint").alias("click_count"))


def popularity(displays: DataFrame, top: int | None = None) -> DataFrame:
    """art, display_count, click_count, rank (by clicks, then art), from art and label. If only the top is asked for,
    each partition cuts its own first; else the catalogue is ranked in ranges."""
    counts = article_counts(displays)
    if not top:
        return ranked(counts, [-F.col("click_count"), F.col("art")])
    counts = counts.orderBy(F.desc("click_count"), "art").limit(top)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("click_count"), "art")).cast("bigint"))


def global_ctr(displays: DataFrame) -> DataFrame:
    """One row: clicks over displays, 0 without displays."""
    return displays.agg(F.coalesce(F.sum("label") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("g"))


def first_seen(displays: DataFrame) -> DataFrame:
    return displays.groupBy("art").agg(F.min("t").alias("first_t"))


def reference_times(displays: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """art, first_t: what an article's age is counted from. Where a catalogue has times of publication (art, published) those count,
    and articles without one have none; else the first display stands in."""
    if published is None:
        return first_seen(displays)
    return published.where("published is not null").groupBy("art").agg(F.min("published").alias("first_t"))


def asof_counts(displays: DataFrame, points: DataFrame, lag: int = LAG, bucket: int = BUCKET) -> DataFrame:
    """displays: art, t, label. points: art, t, and any other columns. Adds display_count, click_count before t.

    A display counts from its time on, a click from lag later: two effects, each with its own time, so one frame does for
    both. Points and effects are unioned in (article, bucket) groups; counts of earlier buckets come as a running sum over
    the few rows that pre-aggregation leaves of an article. So no group is a whole article's log."""
    effects = displays.select("art", F.col("t").alias("e"), F.lit(1).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("c")).unionByName(
        displays.where("label = 1").select("art", (F.col("t") + lag).alias("e"), F.lit(0).cast("bigint").alias("d"), F.lit(1).cast("bigint").alias("c"))
    )
    b = F.floor(F.col("e") / bucket).cast("bigint").alias("b")
    per = effects.select("art", b, "d", "c").groupBy("art", "b").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    marks = per.unionByName(points.select("art", F.floor(F.col("t") / bucket).cast("bigint").alias("b")).distinct().select("art", "b", F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("c")))
    before = marks.groupBy("art", "b").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    w = Window.partitionBy("art").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("art", "b", F.coalesce(F.sum("d").over(w), F.lit(0)).alias("d0"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"))
    none = F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType)
    both = effects.select("art", "e", b, "d", "c", none.alias("point")).unionByName(
        points.select("art", F.col("t").alias("e"), F.floor(F.col("t") / bucket).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("c"), F.struct("*").alias("point"))
    )
    inside = Window.partitionBy("art", "b").orderBy("e").rangeBetween(Window.unboundedPreceding, -1)
    got = both.select("art", "b", "point", F.sum("d").over(inside).alias("d"), F.sum("c").over(inside).alias("c")).where("point is not null")
    out = got.join(before, ["art", "b"], "left")
    return out.select("point.*", (F.coalesce("d", F.lit(0)) + F.coalesce("d0", F.lit(0))).alias("display_count"), (F.coalesce("c", F.lit(0)) + F.coalesce("c0", F.lit(0))).alias("click_count"))


def smoothed(counts: DataFrame, ctr: DataFrame, prior: float = CTR_PRIOR) -> DataFrame:
    """Adds ctr and log_clicks; ctr: the one-row result of global_ctr, made on the training split."""
    return counts.crossJoin(F.broadcast(ctr)).withColumn("ctr", (F.col("click_count") + prior * F.col("g")) / (F.col("display_count") + prior)).withColumn("log_clicks", F.log1p(F.col("click_count").cast("double"))).drop("g")


def click_probabilities(counts: DataFrame) -> DataFrame:
    """art, p for clicked articles; the default for others is 1 / (clicks + 1)."""
    total = counts.agg(F.sum("click_count").alias("total"))
    return counts.where("click_count > 0").crossJoin(F.broadcast(total)).select("art", (F.col("click_count") / F.col("total")).alias("p"))


def head_set(counts: DataFrame, fraction: float) -> DataFrame:
    """The displayed articles that have most clicks: the given part of them, one at least."""
    most = max(1, int(counts.count() * fraction))
    return ranked(counts.select("art", "click_count"), [-F.col("click_count"), F.col("art")]).where(F.col("rank") <= most).select("art")
