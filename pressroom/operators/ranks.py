"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def ranked(df: DataFrame, key: list[Column], name: str = "rank", ranges: int = 64, sample: int = 1024) -> DataFrame:
    """Adds the row's place, from 1, in the order of key, which should tell all rows apart.

    The table is cut into ranges between quantiles of a sample that a hash picks; each range is ranked by itself and offset by
    the rows before it. Which quantiles they are changes no rank."""
    k = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(key)))
    own = stored(df.withColumn("_k", k))  # read three times: for the sample, the sizes and the ranks
    kind = own.schema["_k"].dataType
    some = own.select("_k").orderBy(F.xxhash64("_k"), "_k").limit(sample).orderBy("_k").collect()
    step = max(1, len(some) // ranges)
    edges = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["_k"], kind.fields, strict=True))) for r in some[step::step]]
    own = own.withColumn("_p", F.size(F.filter(F.array(*edges), lambda x: x < F.col("_k"))) if edges else F.lit(0))
    sizes = own.groupBy("_p").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_base"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_k"))
    return own.withColumn("_i", inside).join(F.broadcast(base), "_p").withColumn(name, (F.col("_i") + F.col("_base")).cast("bigint")).drop("_k", "_p", "_i", "_base")
