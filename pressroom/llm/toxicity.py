"""Toxicity: a factorisation machine over hashed terms (fm.py), so that pairs of terms weigh beside single ones.

Null and empty texts are scored by what an empty text has: no terms. A row's score depends on its text alone. So ties
and repeated rows score alike. An empty table gives an empty one; without labels of both classes every score is 0.5. Very long texts
are read whole. The document travels as one struct, so its other columns may have any names. doc_id is a number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .fm import fit, labelled, score

THRESHOLD = 0.7


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def fit_toxicity(docs: DataFrame, labels: DataFrame):
    return fit(*labelled(docs, labels, "toxic", fold(3) != 1, stats=False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score less than the threshold, with their own columns."""
    return score(docs, fit_toxicity(docs, labels)).where(F.col("score") < threshold).select("row.*")


def op4_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit_toxicity(docs, read(spark, sf_dir, "labels"))).select("row.doc_id", "score")
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
