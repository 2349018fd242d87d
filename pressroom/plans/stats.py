"""Queries: popularity, splits, as-of statistics, sessions, impression features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import log_hours, padded, position_bias
from ..operators import beyond, codec, impressions, sessions, stats
from ..operators.split import split_behaviors
from ..sources import adapters as A
from ..sources.adapters import ctes

r6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)


def _train(spark, sf):
    return A.split_of(A.shown(spark, sf), A.orders(spark, sf)).where("split = 'train'")


def popularity(spark, sf):
    return stats.popularity(_train(spark, sf))


def popularity_top(spark, sf):
    return stats.popularity(_train(spark, sf), top=500)


def temporal_split(spark, sf):
    o = A.orders(spark, sf)
    both = split_behaviors(o.where(F.col("t") < A.DEV_FROM), o.where(F.col("t") >= A.DEV_FROM), A.VAL_FRACTION)
    return both.groupBy("split").agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def user_latest_snapshot(spark, sf):
    h = A.split_of(A.histories(spark, sf), A.orders(spark, sf)).select("split", "usr", "t", "imp", F.size("history").cast("bigint").alias("history_length"), F.transform("history", lambda x: x["art"]).alias("arts"))
    return impressions.latest(h, "split", "usr").select("split", "usr", F.col("t").alias("as_of"), "history_length", F.array_join(F.col("arts").cast("array<string>"), " ").alias("history"))


def article_features(spark, sf):
    return A.catalogue(spark, sf).select("art", "title", "abstract", "category", F.lit(None).cast("double").alias("embedding"))


def first_seen(spark, sf):
    return stats.first_seen(A.shown(spark, sf))


def global_ctr(spark, sf):
    return stats.global_ctr(_train(spark, sf)).select(r6("g").alias("g"))


def asof_article_stats(spark, sf):
    s = A.shown(spark, sf)
    points = s.select("imp", "art", "t").distinct()
    out = stats.smoothed(stats.asof_counts(s.select("art", "t", "label"), points), stats.global_ctr(_train(spark, sf)))
    return out.select("imp", "art", "display_count", "click_count", r6("ctr").alias("ctr"), r6("log_clicks").alias("log_clicks"))


def asof_lagged_clicks(spark, sf):
    d = A.displays(spark, sf).withColumnRenamed("click", "label")
    return stats.asof_counts(d.select("art", "t", "label"), d.select("event_id", "art", "t")).select("event_id", "display_count", "click_count")


def smoothed_ctr(spark, sf):
    """The ranking by smoothed click rate at the end of the log."""
    d = A.displays(spark, sf).withColumnRenamed("click", "label")
    counts = d.groupBy("art").agg(F.count("*").alias("display_count"), F.sum("label").cast("bigint").alias("click_count"))
    return stats.smoothed(counts, stats.global_ctr(d)).select("art", "display_count", "click_count", r6("ctr").alias("ctr"))


def freshness_age(spark, sf):
    s = A.shown(spark, sf).select("imp", "art", "t").distinct()
    age = log_hours(F.col("first_t"), F.col("t"))
    return s.join(stats.first_seen(s), "art").select("imp", "art", r6(F.coalesce(age, F.lit(0.0))).alias("age"), age.isNotNull().cast("int").alias("known"))


def age_signal(spark, sf):
    """Share of dated candidates, and exact quantiles and spread of their age in hours."""
    s = A.shown(spark, sf).select("imp", "art", "t").distinct()
    hours = F.when(F.col("first_t") < F.col("t"), (F.col("t") - F.col("first_t")) / 3.6e9)
    d = s.join(stats.first_seen(s), "art").select("imp", hours.alias("h"))
    spread = d.groupBy("imp").agg(F.stddev_pop("h").alias("sd"))
    return d.agg(F.count("*").alias("n"), r6(F.avg(F.col("h").isNotNull().cast("double"))).alias("dated"), r6(F.percentile("h", F.lit(0.5))).alias("median"), r6(F.percentile("h", F.lit(0.9))).alias("p90")).crossJoin(
        spread.agg(r6(F.percentile("sd", F.lit(0.5))).alias("median_spread")))


def sessions_gap30(spark, sf):
    e = A.events(spark, sf).withColumnRenamed("event_id", "imp")
    return sessions.sessions(e).select(F.col("imp").alias("event_id"), "session")


def session_context(spark, sf):
    e = A.events(spark, sf).withColumnRenamed("event_id", "imp").withColumn("clicks", (F.col("kind") == "click").cast("int"))
    return sessions.session_context(sessions.sessions(e)).select(F.col("imp").alias("event_id"), "session_position", "impressions_before", "clicks_before")


def history_category_affinity(spark, sf):
    w = impressions.category_weights(A.histories(spark, sf), A.catalogue(spark, sf))
    out = impressions.affinity(A.shown(spark, sf).select("imp", "art").distinct(), w, A.catalogue(spark, sf))
    return out.select("imp", "art", "category_binary_match", r6("category_affinity").alias("category_affinity"))


def recency_engagement_positional(spark, sf):
    none = F.lit(None).cast("array<bigint>")
    score, timed = impressions.engagement(F.size("history"), none, F.col("t"))
    return A.histories(spark, sf).select("imp", F.size("history").cast("bigint").alias("click_count"), r6(score).alias("engagement"), timed.alias("timed"))


def recency_engagement_decay(spark, sf):
    score, timed = impressions.engagement(F.size("history"), F.transform("history", lambda x: x["t"]), F.col("t"))
    return A.histories(spark, sf).select("imp", r6(score).alias("engagement"), timed.alias("timed"))


def history_dwell(spark, sf):
    """Mean of a user's known values; an error's value is unknown."""
    e = A.events(spark, sf).withColumn("v", F.when(F.col("kind") != "error", F.col("value")))
    lists = e.groupBy("usr").agg(F.collect_list(F.struct("t", "v")).alias("s")).select("usr", F.transform(F.sort_array("s"), lambda x: x["v"]).alias("v"))
    return lists.select("usr", r6(impressions.mean_dwell(F.col("v"))).alias("dwell"), impressions.mean_dwell(F.col("v")).isNotNull().alias("has_dwell"))


def time_features(spark, sf):
    ts = F.timestamp_micros("t")
    return A.events(spark, sf).select("event_id", F.hour(ts).cast("bigint").alias("hour_of_day"), F.weekday(ts).cast("bigint").alias("day_of_week"))


def id_codec(spark, sf):
    return codec.codec(A.catalogue(spark, sf).select("art"), A.shown(spark, sf).select("art"), A.displays(spark, sf).select("art"))


def history_truncate_pad(spark, sf):
    codes = codec.codec(A.catalogue(spark, sf).select("art"))
    long = A.histories(spark, sf).select("imp", F.posexplode_outer("history").alias("i", "h")).select("imp", "i", F.col("h.art").alias("art"))
    own = codec.encode(long, codes).groupBy("imp").agg(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.col("code").cast("int").alias("c"))))).alias("s"))
    return own.select("imp", F.array_join(padded(F.transform("s", lambda x: x["c"]), config.HISTORY_LENGTH).cast("array<string>"), " ").alias("codes"))


def token_matrix(spark, sf):
    return codec.token_codes(A.catalogue(spark, sf), config.TITLE_TOKENS, 30_000).select("art", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


def position_biases(spark, sf):
    return A.shown(spark, sf).select("imp", "pos", "art", r6(position_bias(F.col("pos"))).alias("natural"), r6(position_bias(F.col("pos"), 2)).alias("binary"))


def click_probabilities(spark, sf):
    counts = stats.article_counts(_train(spark, sf))
    return stats.click_probabilities(counts).select("art", F.round("p", 9).alias("p"))


def head_articles(spark, sf):
    return stats.head_set(stats.article_counts(_train(spark, sf)), 0.2)


def coverage(spark, sf):
    lists = A.shown(spark, sf).where("pos <= 3").groupBy("imp").agg(F.collect_list("art").alias("arts"))
    return beyond.coverage(lists, A.catalogue(spark, sf).count()).select(r6("coverage").alias("coverage"))


QUERIES = {f.__name__: f for f in (
    popularity, popularity_top, temporal_split, user_latest_snapshot, article_features, first_seen, global_ctr, asof_article_stats, asof_lagged_clicks, smoothed_ctr, freshness_age, age_signal, sessions_gap30, session_context,
    history_category_affinity, recency_engagement_positional, recency_engagement_decay, history_dwell, time_features, id_codec, history_truncate_pad, token_matrix, position_biases, click_probabilities, head_articles, coverage,
)}

_POP = "pop as (select art, count(*) display_count, cast(sum(label) as bigint) click_count from sp where split = 'train' group by art)"
_TRAIN = ctes("orders", "shown", "cut", "split")
_SEEN = ctes("orders", "shown") + ", seen as (select art, min(t) first_t from shown group by art), pts as (select distinct imp, art, t from shown)"
_GAP = ctes("events") + ", b as (select *, case when t - lag(t) over (partition by usr order by t, event_id) > 1800000000 then 1 else 0 end nw from ev), s as (select *, cast(usr as varchar) || '_s' || cast(sum(nw) over (partition by usr order by t, event_id rows unbounded preceding) as varchar) session from b)"
_HIST = ctes("orders", "shown", "history")
ORACLES = {
    "popularity": f"{_TRAIN}, {_POP} select *, row_number() over (order by click_count desc, art) rank from pop",
    "popularity_top": f"{_TRAIN}, {_POP} select *, row_number() over (order by click_count desc, art) rank from pop qualify rank <= 500",
    "temporal_split": ctes("orders", "cut", "osplit") + " select split, count(*) n, min(t) t_min, max(t) t_max from osp group by split",
    "user_latest_snapshot": ctes("orders", "shown", "cut", "osplit", "history") + ", l as (select *, row_number() over (partition by split, usr order by t desc, imp desc) k from osp), g as (select imp, count(*) n, string_agg(cast(art as varchar), ' ' order by i) h from hist group by imp) select split, usr, t as_of, coalesce(n, 0) history_length, coalesce(h, '') history from l left join g using (imp) where k = 1",
    "article_features": "select p_partkey art, p_name title, p_type abstract, p_brand category, cast(null as double) embedding from part",
    "first_seen": ctes("orders", "shown") + " select art, min(t) first_t from shown group by art",
    "global_ctr": f"{_TRAIN} select round(sum(label) / count(*), 6) g from sp where split = 'train'",
    "asof_article_stats": f"{_TRAIN}, g as (select sum(label) / count(*) g from sp where split = 'train'), pts as (select distinct imp, art, t from shown), c as (select p.imp, p.art, count(s.imp) d, coalesce(sum(case when s.t < p.t - 600000000 then s.label else 0 end), 0) k from pts p left join shown s on p.art = s.art and s.t < p.t group by p.imp, p.art) select imp, art, d display_count, cast(k as bigint) click_count, round((k + 50 * g) / (d + 50), 6) ctr, round(ln(1 + k), 6) log_clicks from c, g",
    "asof_lagged_clicks": ctes("events", "displays") + " select p.event_id, count(s.event_id) display_count, cast(coalesce(sum(case when s.t < p.t - 600000000 then s.click else 0 end), 0) as bigint) click_count from dis p left join dis s on p.art = s.art and s.t < p.t group by p.event_id",
    "smoothed_ctr": ctes("events", "displays") + ", g as (select sum(click) / count(*) g from dis) select art, count(*) display_count, cast(sum(click) as bigint) click_count, round((sum(click) + 50 * max(g)) / (count(*) + 50), 6) ctr from dis, g group by art",
    "freshness_age": _SEEN + " select imp, art, round(case when first_t < t then ln(1 + (t - first_t) / 3600000000.0) else 0.0 end, 6) age, cast(first_t < t as int) known from pts join seen using (art)",
    "age_signal": _SEEN + ", d as (select imp, case when first_t < t then (t - first_t) / 3600000000.0 end h from pts join seen using (art)), sd as (select stddev_pop(h) sd from d group by imp) select (select count(*) from d) n, round((select avg(cast(h is not null as int)) from d), 6) dated, round((select quantile_cont(h, 0.5) from d), 6) median, round((select quantile_cont(h, 0.9) from d), 6) p90, round((select quantile_cont(sd, 0.5) from sd), 6) median_spread",
    "sessions_gap30": f"{_GAP} select event_id, session from s",
    "session_context": f"{_GAP} select event_id, row_number() over w session_position, row_number() over w - 1 impressions_before, cast(coalesce(sum(cast(kind = 'click' as int)) over (partition by session order by t, event_id rows between unbounded preceding and 1 preceding), 0) as bigint) clicks_before from s window w as (partition by session order by t, event_id)",
    "history_category_affinity": _HIST + ", w as (select imp, p_brand c, sum(pow(0.9, n - i)) w from hist join part on art = p_partkey group by imp, p_brand), sh as (select imp, c, w / sum(w) over (partition by imp) s from w), cand as (select distinct imp, art from shown) select cand.imp, cand.art, cast(s is not null as int) category_binary_match, round(coalesce(s, 0.0), 6) category_affinity from cand left join part on cand.art = p_partkey left join sh on cand.imp = sh.imp and sh.c = p_brand",
    "recency_engagement_positional": _HIST + " select o.imp, count(h.imp) click_count, round(coalesce(sum(pow(0.9, h.n - h.i)), 0.0), 6) engagement, false timed from ord o left join hist h using (imp) group by o.imp",
    "recency_engagement_decay": _HIST + " select o.imp, round(coalesce(sum(exp(-ln(2) / 168.0 * ((h.t - h.ct) / 3600000000.0))), 0.0), 6) engagement, count(h.imp) > 0 timed from ord o left join hist h using (imp) group by o.imp",
    "history_dwell": ctes("events") + " select usr, round(avg(case when kind <> 'error' then value end), 6) dwell, count(case when kind <> 'error' then value end) > 0 has_dwell from ev group by usr",
    "time_features": "select event_id, extract(hour from ts) hour_of_day, isodow(ts) - 1 day_of_week from events",
    "id_codec": ctes("orders", "shown", "events", "displays") + " select art, row_number() over (order by art) code from (select p_partkey art from part union select art from shown union select art from dis) where art is not null",
    "history_truncate_pad": _HIST + f", c as (select p_partkey art, row_number() over (order by p_partkey) code from part), h as (select imp, list(coalesce(code, 0) order by i) s from hist left join c using (art) group by imp), x as (select o.imp, coalesce(s, []) s from ord o left join h using (imp)) select imp, array_to_string([0 for k in range(greatest({config.HISTORY_LENGTH} - len(s), 0))] || s[greatest(len(s) - {config.HISTORY_LENGTH - 1}, 1):], ' ') codes from x",
    "token_matrix": rf"with w as (select p_partkey art, regexp_extract_all(lower(p_name), '([\p{{L}}\p{{N}}_]+)')[1:{config.TITLE_TOKENS}] w from part) select art, array_to_string([cast(('0x' || substr(md5(x), 1, 8))::bigint % 30000 + 1 as varchar) for x in w] || ['0' for k in range({config.TITLE_TOKENS} - len(w))], ' ') tokens from w",
    "position_biases": ctes("orders", "shown") + " select imp, pos, art, round(1 / ln(pos + 2), 6) \"natural\", round(1 / log2(pos + 2), 6) \"binary\" from shown",
    "click_probabilities": f"{_TRAIN}, {_POP} select art, round(click_count / sum(click_count) over (), 9) p from pop where click_count > 0",
    "head_articles": f"{_TRAIN}, {_POP} select art from pop qualify row_number() over (order by click_count desc, art) <= greatest(1, cast(floor(0.2 * count(*) over ()) as bigint))",
    "coverage": ctes("orders", "shown") + " select round(count(distinct art) / (select count(*) from part), 6) coverage from shown where pos <= 3",
}
