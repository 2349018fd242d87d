"""Reports of one row: what article age tells, and measures beyond accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOOTSTRAP_DRAWS, MICROS_HOUR, SEED
from ..sources.shared import stored
from . import beyond, metrics


def _median(x: Column) -> Column:
    """Of hours, to a tenth: so few values differ that one task can hold their counts."""
    return F.percentile(F.round(x, 1), F.lit(0.5))


def age_signal(rows: DataFrame, references: DataFrame, log: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """rows: imp, pos, art, t, label; references: art, ref (when the article appeared); log: t of all impressions; truth: art, ref, where known.

    A candidate is dated if its reference lies before the impression. An article already there in the log's first hour is censored: its
    reference says when the log began. Freshest first is an AUC over impressions in which all candidates are dated. With truth come the
    proxy's gap to it (true age - age) and the true age of censored candidates."""
    age = lambda ref: F.when(ref < F.col("t"), (F.col("t") - ref) / float(MICROS_HOUR))
    start = log.agg(F.min("t").alias("start"))
    d = rows.join(references, "art", "left").crossJoin(F.broadcast(start)).withColumn("h", age(F.col("ref")))
    dated, clicked = F.col("h").isNotNull(), F.col("label") == 1
    censored = dated & (F.col("ref") <= F.col("start") + MICROS_HOUR)
    n = lambda c: F.sum(c.cast("bigint"))
    more = []
    if truth is not None:
        d = d.join(truth.select("art", F.col("ref").alias("true_ref")), "art", "left").withColumn("true_h", age(F.col("true_ref")))
        gap = F.col("true_h") - F.col("h")
        more = [_median(gap).alias("median_gap"), F.avg((gap > 24).cast("double")).alias("gap_over_day"), _median(F.when(censored, F.col("true_h"))).alias("censored_true_age")]
    one = d.agg(
        F.count("*").alias("n_candidates"), F.avg(dated.cast("double")).alias("dated"), (n(dated & clicked) / n(clicked)).alias("clicks_dated"),
        _median(F.when(clicked, F.col("h"))).alias("median_clicked"), _median(F.when(~clicked, F.col("h"))).alias("median_other"), (n(censored) / F.greatest(n(dated), F.lit(1))).alias("censored"), *more,
    )
    by_imp = d.groupBy("imp").agg(F.count("*").alias("n"), F.count("h").alias("k"), F.stddev_pop("h").alias("sd"))
    spread = by_imp.where("k > 1").agg(_median(F.col("sd")).alias("median_spread"))
    whole = d.join(by_imp.where("n = k").select("imp"), "imp", "left_semi").select("imp", "pos", "label", (-F.col("h")).alias("score"))
    fresh = metrics.per_impression(whole).agg(F.avg("auc").alias("freshest_first_auc"), F.count("auc").alias("n_freshest_first"))
    return one.crossJoin(spread).crossJoin(fresh)  # one row each


def beyond_accuracy(scored: DataFrame, vectors: DataFrame, vec: Column, probabilities: DataFrame, default: Column, catalogue_size: int, k: int = 10, draws: int = BOOTSTRAP_DRAWS, seed: int = SEED) -> DataFrame:
    """scored: imp, pos, art, score. Diversity, novelty and coverage of the first k of each impression, with intervals, and diversity
    against that of random pairs. vec: the vector of an article."""
    by = Window.partitionBy("imp").orderBy(F.desc("score"), "pos")
    top = scored.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    lists = stored(top.groupBy("imp").agg(F.collect_list("art").alias("arts"), F.collect_list(vec).alias("vecs")))  # k at most; read six times
    out = lists.agg(F.count("*").alias("n_impressions"), F.lit(k).cast("bigint").alias("top_k"), F.lit(catalogue_size).cast("bigint").alias("catalogue_size"))
    both = beyond.diversity(lists, vectors).join(beyond.novelty(lists, probabilities, default), "imp")
    ci = beyond.bootstraps(both.withColumnRenamed("imp", "id"), ["diversity", "novelty"], draws=draws, seed=seed)
    one = lambda name, c: F.max(F.when(F.col("metric") == name, F.col(c)))
    out = out.crossJoin(ci.agg(*(one(name, c).alias(f"{name}{end}") for name in ("diversity", "novelty") for c, end in (("mean", ""), ("lo", "_lo"), ("hi", "_hi")))))
    covered = beyond.coverage_bootstrap(lists, catalogue_size, draws=draws, seed=seed)
    out = out.crossJoin(covered.select("coverage", F.col("lo").alias("coverage_lo"), F.col("hi").alias("coverage_hi")))
    out = out.crossJoin(beyond.random_pair_diversity(vectors, seed=seed).select(F.col("diversity").alias("random_diversity")))
    return out.withColumn("diversity_vs_random", F.when(F.col("random_diversity") != 0, F.col("diversity") / F.col("random_diversity")))
