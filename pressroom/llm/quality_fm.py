"""Quality: a factorisation machine (fm.py) over hashed words, statistics of structure in bins, and the text's length as metadata.

Null and empty texts are scored by the bins of an empty text. A row's score depends on its text alone. So ties
and repeated rows score alike. An empty table gives an empty one; without labels of both classes every score is 0.5. Very long texts
are read whole. The document travels as one struct, so its other columns may have any names. doc_id is a number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .fm import fit, labelled, score
from .toxicity import fold

THRESHOLD = 0.3


def fit_quality(docs: DataFrame, labels: DataFrame):
    return fit(*labelled(docs, labels, "quality", fold(5) != 0, stats=True))


def op2_quality_fm(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit_quality(docs, read(spark, sf_dir, "labels"))).select("row.doc_id", "score")
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
