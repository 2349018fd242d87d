"""Streams over files: what is there is read in chunks, and a job that was killed goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CTR_PRIOR, SESSION_GAP_MINUTES

#: State with timers needs this store; it also keeps state on disk instead of in the heap.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _run(writer, spark: SparkSession) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()


def run_append(df: DataFrame, out: str, checkpoint: str, form: str = "parquet") -> None:
    """All that is there now, to files that hold each row once."""
    _run(df.writeStream.format(form).option("path", out).option("checkpointLocation", checkpoint).outputMode("append"), df.sparkSession)


def run_table(df: DataFrame, out: str, checkpoint: str) -> None:
    """An aggregation's whole result after each chunk, over the one before: a chunk that is done again gives the same table."""
    _run(df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode("complete"), df.sparkSession)


def run_chunks(df: DataFrame, of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """of (a query of any kind) over each chunk of the stream, to a folder of the chunk's number: a chunk that is done again replaces itself."""
    _run(df.writeStream.foreachBatch(lambda b, k: of(b).write.mode("overwrite").parquet(f"{out}/chunk={k}")).option("checkpointLocation", checkpoint), df.sparkSession)


def first_seen(displays: DataFrame) -> DataFrame:
    return displays.groupBy("art").agg(F.min("t").alias("first_t"))


def _gap(minutes: int) -> str:
    """Session windows end at a gap of the given length, so a microsecond more is asked for: a gap of just that length stays inside."""
    return f"{minutes * 60_000_000 + 1} microseconds"


def _session(events: DataFrame, gap_minutes: int) -> DataFrame:
    ends = events.groupBy("usr", F.session_window("ts", _gap(gap_minutes)).alias("w"))
    return ends.agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).drop("w")


def session_counts(events: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """events: usr, t. Sessions by the engine's session windows, for a table that is written whole after each chunk."""
    return _session(events.withColumn("ts", F.timestamp_micros("t")), gap_minutes)


def closed_sessions(events: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, delay: str = "0 seconds") -> DataFrame:
    """events: event_id, usr, t. Each session once, when the watermark has passed its end, after which its state goes; those still open wait. An
    event that is sent again within the watermark's delay counts once; one that comes behind the watermark is dropped, and shows in the query's progress."""
    timed = events.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", delay)
    return _session(timed.dropDuplicatesWithinWatermark(["event_id"]), gap_minutes)


def ranked(scored: DataFrame) -> DataFrame:
    """impression_id, scores (in place order) to a line of ranks, without state: ties give the earlier position the better rank."""
    s = F.transform("scores", lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    order = F.transform(F.array_sort(s), lambda x: x["i"])
    ranks = F.transform(F.sequence(F.lit(0), F.size("scores") - 1), lambda i: F.array_position(order, i).cast("string"))
    return scored.select(F.concat(F.col("impression_id").cast("string"), F.lit(" ["), F.array_join(F.when(F.size("scores") > 0, ranks).otherwise(F.array().cast("array<string>")), ","), F.lit("]")).alias("value"))


def versions(log: DataFrame) -> DataFrame:
    """log: art, t, label. Returns art, b, e, displays, clicks: what was shown and clicked of an article before any time in (b, e]. A row for each time at which it was shown, and
    one before; the window holds an article's times, not its displays."""
    at = log.groupBy("art", "t").agg(F.count("*").alias("n"), F.sum("label").alias("c"))
    own = Window.partitionBy("art").orderBy("t")
    run = lambda c: F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias({"n": "displays", "c": "clicks"}[c])
    return at.select("art", F.col("t").alias("b"), F.lead("t").over(own).alias("e"), run("n"), run("c"))


def lookup_scores(chunk: DataFrame, stats: DataFrame, catalogue: DataFrame, priors: DataFrame, default: float, prior: float = CTR_PRIOR) -> DataFrame:
    """chunk: impression_id, t, candidates. Looks up each candidate's counts as of t (stats: see versions), its category (catalogue: art, category) and that category's rate
    (priors: category, ctr), and returns impression_id and scores in place order: (clicks + prior * rate) / (displays + prior). Unknown articles and categories have no counts
    and the default rate."""
    rows = chunk.select("impression_id", "t", F.posexplode_outer("candidates").alias("pos", "art"))
    hit = rows.join(catalogue, "art", "left").join(priors, "category", "left")
    hit = hit.join(stats, (hit["art"] == stats["art"]) & (hit["t"] > stats["b"]) & (hit["t"] <= F.coalesce(stats["e"], F.lit((1 << 63) - 1))), "left").drop(stats["art"])
    rate = F.coalesce("ctr", F.lit(default))
    hit = hit.withColumn("score", F.when(F.col("pos").isNotNull(), (F.coalesce("clicks", F.lit(0)) + prior * rate) / (F.coalesce("displays", F.lit(0)) + prior)))
    lists = hit.groupBy("impression_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "score")))).alias("s"))
    return lists.select("impression_id", F.transform("s", lambda x: x["score"]).alias("scores"))
