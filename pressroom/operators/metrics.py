"""Ranking metrics by impression, and over the whole population.

Ties in metrics: of equal scores the later position ranks first. In submissions it is the earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def per_impression(scored: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """scored: imp, pos, score, label. Returns imp, auc (null if one class lacks), mrr, ndcg_at k. All windows share one exchange by impression."""
    by = Window.partitionBy("imp")
    w = by.orderBy(F.desc("score"), F.desc("pos"))
    r = scored.select(
        "imp", "label", F.row_number().over(w).alias("r"), F.row_number().over(by.orderBy(F.desc("label"), "pos")).alias("ideal"),
        (F.rank().over(by.orderBy("score")) + (F.count("*").over(Window.partitionBy("imp", "score")) - 1) / 2).alias("avg_rank"),
    )
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    dcg = lambda at, k: F.sum(F.when(F.col(at) <= k, gain / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    p, n = F.sum("label"), F.sum(1 - F.col("label"))
    auc = F.when((p > 0) & (n > 0), (F.sum(F.col("avg_rank") * F.col("label")) - p * (p + 1) / 2) / (p * n))
    out = r.groupBy("imp").agg(auc.alias("auc"), F.when(p > 0, F.sum(F.col("label") / F.col("r")) / p).otherwise(0.0).alias("mrr"), *(F.when(dcg("ideal", k) > 0, dcg("r", k) / dcg("ideal", k)).otherwise(0.0).alias(f"ndcg_{k}") for k in ks))
    return out


def population(per: DataFrame, impressions: DataFrame, *by: str) -> DataFrame:
    """Means over all impressions, an unscored one counting 0; AUC over those where it is defined. impressions: imp and slices."""
    names = [c for c in per.columns if c not in ("imp", "auc")]
    both = impressions.join(per, "imp", "left")
    return both.groupBy(*by).agg(F.count("*").alias("n_impressions"), F.count("mrr").alias("n_scored"), F.avg("auc").alias("auc"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names))


def recall(found: DataFrame, clicked: DataFrame) -> DataFrame:
    """Mean part of the clicks that was retrieved, over impressions with both. found, clicked: imp and a list."""
    both = found.join(clicked, "imp").where(F.size("clicked") > 0)
    return both.agg(F.avg(F.size(F.array_intersect("candidates", "clicked")) / F.size(F.array_distinct("clicked"))).alias("recall"))


def hit_rate(found: DataFrame, clicked: DataFrame, k: int, impressions: DataFrame) -> DataFrame:
    """Part of all impressions that have a click among the first k."""
    both = impressions.join(found, "imp", "left").join(clicked, "imp", "left")
    return both.agg(F.avg(F.coalesce(F.arrays_overlap(F.slice("candidates", 1, k), "clicked"), F.lit(False)).cast("double")).alias("hit_rate"))


def submission(scored: DataFrame) -> DataFrame:
    """impression_id, ranks: for each position its rank by score, of equal scores the earlier position first."""
    w = Window.partitionBy("imp").orderBy(F.desc("score"), "pos")
    r = scored.select("imp", "pos", F.row_number().over(w).alias("r"))
    return r.groupBy("imp").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("s")).select(F.col("imp").alias("impression_id"), F.transform("s", lambda x: x["r"]).alias("ranks"))


def paired(base: DataFrame, other: DataFrame) -> DataFrame:
    """imp, base_score, arm_score, label of two prediction tables (imp, pos, score, label); different populations or labels are an error."""
    key = ["imp", "pos"]
    one = lambda df, score, label, there: df.select(*key, F.col("score").alias(score), F.col("label").alias(label), F.lit(True).alias(there))
    both = stored(one(base, "base_score", "label", "_b").join(one(other, "arm_score", "_l", "_o"), key, "full"))  # used twice, and joined once
    odd = both.agg(F.max(F.col("_b").isNull() | F.col("_o").isNull()).alias("rows"), F.max(F.col("label") != F.col("_l")).alias("labels")).first()
    if odd["rows"]:
        raise ValueError("the two arms don't cover the same candidates")
    if odd["labels"]:
        raise ValueError("the two arms differ in labels")
    return both.select(*key, "base_score", "label", "arm_score")
