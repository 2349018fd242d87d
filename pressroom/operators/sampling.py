"""Seeded samples by hash: the same rows on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NEGATIVES_HARD, NEGATIVES_RANDOM, SEED, WU_NEGATIVES
from ..functions.scalars import draw
from .ranks import ranked


def fraction(df: DataFrame, id_: str, part: float, seed: int = SEED) -> DataFrame:
    return df.where(draw(seed, F.col(id_)) % 1_000_000 < int(part * 1_000_000))


def fixed(df: DataFrame, id_: str, n: int, seed: int = SEED) -> DataFrame:
    """The n rows with the least draw; each partition cuts its own first."""
    return df.orderBy(draw(seed, F.col(id_)), id_).limit(n)


def middle(df: DataFrame, n: int) -> DataFrame:
    """The n rows in the middle of the order of (t, imp), by ranks that are counted in ranges."""
    skip = max(0, (df.count() - n) // 2)
    return ranked(df, [F.col("t"), F.col("imp")], "_rank").where(F.col("_rank").between(skip + 1, skip + n)).drop("_rank")


def negatives(candidates: DataFrame, hard: int = NEGATIVES_HARD, random: int = NEGATIVES_RANDOM, seed: int = SEED) -> DataFrame:
    """candidates: imp, art, rank, label. All positives, the `hard` best ranked negatives, and `random` others by draw."""
    by = Window.partitionBy("imp", "label")
    kept = candidates.withColumn("_h", F.row_number().over(by.orderBy("rank", "art")))
    is_hard = (F.col("label") == 0) & (F.col("_h") <= hard)
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("imp", "label", is_hard).orderBy(draw(seed, F.col("imp"), F.col("art")), "rank", "art")))
    return kept.where((F.col("label") == 1) | is_hard | (F.col("_r") <= random)).drop("_h", "_r")


def wu(shown: DataFrame, n: int = WU_NEGATIVES, seed: int = SEED) -> DataFrame:
    """imp, pos, candidates, label: for each click, n negatives of its impression drawn with replacement, in a drawn order; label is the click's place (from 0). Impressions without negatives are left out."""
    groups = shown.groupBy("imp").agg(
        F.sort_array(F.collect_list(F.when(F.col("label") == 1, F.struct("pos", "art")))).alias("yes"), F.sort_array(F.collect_list(F.when(F.col("label") == 0, F.struct("pos", "art")))).alias("no")
    ).where("size(no) > 0")
    rows = groups.select("imp", "no", F.explode("yes").alias("y")).select("imp", "no", F.col("y.pos").alias("pos"), F.col("y.art").alias("art"))
    picks = rows.select("imp", "pos", "art", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"), "no")
    picks = picks.withColumn("a", F.when(F.col("i") == 0, F.col("art")).otherwise(F.get("no", (draw(seed, F.col("imp"), F.col("pos"), F.col("i")) % F.size("no")).cast("int"))["art"]))
    order = F.struct(draw(seed + 1, F.col("imp"), F.col("pos"), F.col("i")), F.col("i").alias("i"), F.col("a").alias("a"))
    out = picks.groupBy("imp", "pos").agg(F.sort_array(F.collect_list(order)).alias("s"))
    return out.select("imp", "pos", F.transform("s", lambda x: x["a"]).alias("candidates"), (F.array_position(F.transform("s", lambda x: x["i"]), 0) - 1).cast("bigint").alias("label"))
