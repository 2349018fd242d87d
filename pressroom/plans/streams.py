"""Queries that run a stream over what is there, to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources.adapters import ctes
from ..sources.shared import Grouped, folder, stored
from ..streaming import jobs, pool


def _events(spark, sf):
    """The events table as a stream, whether it is a file or a folder."""
    path = f"{sf}/events.parquet"
    batch = spark.read.parquet(path)
    if any(f.endswith("/events.parquet") for f in batch.inputFiles()):  # a stream's source must be a folder
        raw = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        raw = spark.readStream.schema(batch.schema).parquet(path)  # as one chunk: its files may overlap in time
    return raw.select("event_id", F.col("user_id").alias("usr"), A.micros("ts").alias("t"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("art"))


def _displays(spark, sf):
    return _events(spark, sf).where(F.col("kind").isin("view", "click")).select("event_id", "art", "t", (F.col("kind") == "click").cast("int").alias("click"))


def stream_fresh_pool(spark, sf):
    out, mark = folder(spark), folder(spark)
    jobs.run_append(pool.windows(_displays(spark, sf), 6, 24, 10), out, mark)
    return spark.read.schema(pool.OUT).parquet(out)


def stream_first_seen(spark, sf):
    out, mark = folder(spark), folder(spark)
    jobs.run_table(jobs.first_seen(_displays(spark, sf)), out, mark)
    return spark.read.parquet(out)


def stream_sessions(spark, sf):
    out, mark = folder(spark), folder(spark)
    jobs.run_table(jobs.session_counts(_events(spark, sf).select("usr", "t")), out, mark)
    return spark.read.parquet(out)


def stream_ranked(spark, sf):
    """Orders' lines ranked by price, as lines of a submission, through a stream of stored impressions."""
    store, out, mark = folder(spark), folder(spark), folder(spark)
    lists = A.shown(spark, sf).groupBy("imp").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "art"))), lambda x: (x["art"] % 7).cast("double")).alias("scores"))
    lists.select(F.col("imp").alias("impression_id"), "scores").write.parquet(store)
    jobs.run_append(jobs.ranked(jobs.files(spark, store, "impression_id bigint, scores array<double>", 4)), out, mark)
    return spark.read.schema("value string").parquet(out)


def stream_sessions_closed(spark, sf):
    """Sessions that have ended by the newest event's time."""
    out, mark = folder(spark), folder(spark)
    jobs.run_append(jobs.closed_sessions(_events(spark, sf).select("event_id", "usr", "t")), out, mark)
    return spark.read.schema("usr bigint, n bigint, first_t bigint, last_t bigint").parquet(out)


def stream_scored(spark, sf):
    """Orders of the test split, a chunk at a time, scored by lookups of counts as of their time, categories and their rates, and ranked."""
    rows = A.split_of(A.shown(spark, sf), A.orders(spark, sf))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    catalogue = A.catalogue(spark, sf).select("art", "category")
    counts = stored(train.groupBy("art").agg(F.sum("label").alias("c"), F.count("*").alias("n")))  # used twice
    rate = (F.sum("c") / F.sum("n")).alias("ctr")
    priors = stored(counts.join(catalogue, "art").groupBy("category").agg(rate))
    default = counts.agg(rate).first()[0] or 0.0
    store, out, mark = folder(spark), folder(spark), folder(spark)
    lists = test.groupBy(F.col("imp").alias("impression_id"), "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "art"))), lambda x: x["art"]).alias("candidates"))
    # As many files on any table: each chunk looks through the statistics, which lie bucketed, so that a chunk shuffles its own rows only.
    lists.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "impression_id").write.parquet(store)
    tables = Grouped(spark, "art", A.parts(spark))
    stats = tables.store(jobs.versions(A.shown(spark, sf).select("art", "t", "label")), "b")
    try:
        chunks = jobs.files(spark, store, "impression_id bigint, t bigint, candidates array<bigint>", 4)
        jobs.run_chunks(chunks, lambda c: jobs.ranked(jobs.lookup_scores(c, stats, catalogue, priors, default)), out, mark)
    finally:
        tables.drop()
    return spark.read.schema("value string").parquet(f"{out}/*")


QUERIES = {f.__name__: f for f in (stream_fresh_pool, stream_first_seen, stream_sessions, stream_ranked, stream_sessions_closed, stream_scored)}
_H = 3_600_000_000
ORACLES = {
    "stream_fresh_pool": ctes("events", "displays") + f" select q.event_id, q.art, q.t, count(e.t) filter (e.t >= q.t - {6 * _H}) shown, count(e.t) shown_back, count(e.t) filter (e.click = 1 and e.t >= q.t - {6 * _H} and e.t < q.t - 600000000) clicked, false late from dis q left join dis e on e.art = q.art and e.t < q.t and e.t >= q.t - {24 * _H} group by q.event_id, q.art, q.t",
    "stream_first_seen": ctes("events", "displays") + " select art, min(t) first_t from dis group by art",
    "stream_sessions": ctes("events") + ", b as (select *, case when t - lag(t) over (partition by usr order by t, event_id) > 1800000000 then 1 else 0 end nw from ev), s as (select *, sum(nw) over (partition by usr order by t, event_id rows unbounded preceding) s from b) select usr, count(*) n, min(t) first_t, max(t) last_t from s group by usr, s",
    "stream_ranked": ctes("orders", "shown") + ", r as (select imp, pos, row_number() over (partition by imp order by art % 7 desc, pos) r from shown) select imp || ' [' || string_agg(cast(r as varchar), ',' order by pos) || ']' as value from r group by imp",
    "stream_sessions_closed": ctes("events") + ", b as (select *, case when t - lag(t) over (partition by usr order by t, event_id) > 1800000000 then 1 else 0 end nw from ev), s as (select *, sum(nw) over (partition by usr order by t, event_id rows unbounded preceding) s from b), g as (select usr, count(*) n, min(t) first_t, max(t) last_t from s group by usr, s) select * from g where last_t + 1800000001 <= (select max(t) // 1000 * 1000 from ev)",
    "stream_scored": ctes("orders", "shown", "cut", "split") + """, c as (select p_brand, sum(label) / count(*) ctr from sp join part on art = p_partkey where split = 'train' group by p_brand), g as (select sum(label) / count(*) g from sp where split = 'train'),
k as (select q.imp, q.pos, count(s.imp) d, coalesce(sum(s.label), 0) k from sp q left join shown s on s.art = q.art and s.t < q.t where q.split = 'test' group by q.imp, q.pos),
r as (select imp, pos, row_number() over (partition by imp order by (k + 50 * coalesce(ctr, g)) / (d + 50) desc, pos) r from sp join k using (imp, pos) left join part on p_partkey = art left join c using (p_brand), g)
select imp || ' [' || string_agg(cast(r as varchar), ',' order by pos) || ']' as value from r group by imp""",
}
