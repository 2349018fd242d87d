"""Temporal split: a span of time, not of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def val_cutoff(period: DataFrame, fraction: float) -> F.Column:
    """The time from which a period's rows are validation, as a literal: (1 - fraction) of the way from first to last."""
    r = period.agg(F.floor(F.min("t") + (F.max("t") - F.min("t")) * (1 - fraction)).cast("bigint").alias("c")).first()
    return F.lit(r.c)


def split_behaviors(train: DataFrame, dev: DataFrame, fraction: float) -> DataFrame:
    """Columns of both, with split; the later period must begin after the earlier one ends."""
    out = train.withColumn("split", F.when(F.col("t") >= val_cutoff(train, fraction), "val").otherwise("train")).unionByName(dev.withColumn("split", F.lit("test")))
    last = train.agg(F.max("t")).first()[0]
    first = dev.agg(F.min("t")).first()[0]
    if last is not None and first is not None and last > first:
        raise ValueError(f"the later period begins at {first}, before the earlier ends at {last}")
    return out
