"""A corpus pipeline of five stages over documents, each on all its predecessor kept; corpus_pipeline.py at the top gives it out.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, the last adds size, shard and slot.
Nulls, in any column: a document without a text is no one's duplicate, holds no benchmark item, is scored for toxicity as an
empty one, is mixed and sharded like others; one without a doc_id, too, and null sources are a source. Ties and repeated rows: rows
equal in doc_id and text are judged alike, near_dedup keeps one of them, mixing repeats them alike, and each gets a slot of its own. Empty and very
long texts: each stage reads whole texts, of any length. Empty tables:
each stage returns an empty table of its columns; without labels toxicity keeps all, without benchmark items decontamination does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .decontamination import decontaminate
from .mixing import mix
from .near_dedup import drop_near_duplicates
from .sharding import shard
from .toxicity import drop_toxic

SHARDS = 24


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays (five-word shingles, 0.8)."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, in a global order."""
    return mix(docs).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their columns, and size, shard and slot beside them, in the place of columns so called."""
    out = shard(docs, SHARDS)
    size = (F.octet_length(F.coalesce("row.text", F.lit(""))) + 8).cast("long").alias("size")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "shard", "slot")), size, "shard", "slot")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The toxicity model and the ring can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
