"""Queries over raw files: each writes the driver's tables in a raw format, reads them with the reader, and returns what it read.

Files go to the shared folder; both datasets' formats, odd lines included (unbalanced quotes, empty fields, broken JSON, repeated
users, ids in two periods)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, stats
from ..sources import adapters as A
from ..sources import readers, sinks
from ..sources.adapters import ctes
from ..sources.shared import folder

TIME = "M/d/yyyy h:mm:ss a"


def _text(c, sep=" "):
    return F.array_join(F.col(c).cast("array<string>"), sep).alias(c)


def _lines(df: DataFrame, path: str, *cols) -> None:
    df.select(F.concat_ws("\t", *cols).alias("value")).write.text(path)


def _news(spark, sf, path: str, where: str = "true", mark: str = "") -> None:
    """A title may begin with a quote that nothing closes; every third abstract is empty; every second entity list is broken."""
    part = A.table(spark, sf, "part").where(where)
    s = lambda x: F.col(x).cast("string")
    entities = F.concat(F.lit('[{"Label": "'), s("p_brand"), F.lit('"}, {"No": 1}]'))
    broken = F.when(F.col("p_size") % 2 == 0, F.lit("not json")).otherwise(F.lit('[{"Label": "x"}]'))
    abstract = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(s("p_type"))
    _lines(part, path, F.concat(F.lit("N"), s("p_partkey")), s("p_brand"), s("p_type"), F.concat(F.lit('"' + mark), s("p_name")), abstract, F.lit("u"), entities, broken)


def _behaviors(spark, sf, path: str, labels: bool = True) -> None:
    shown = A.shown(spark, sf).withColumn("token", F.concat(F.lit("N"), F.col("art"), *([F.lit("-"), F.col("label")] * labels)))
    shown = shown.groupBy("imp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("shown"))
    h = A.histories(spark, sf).select("imp", "usr", "t", F.array_join(F.transform("history", lambda x: F.concat(F.lit("N"), x["art"])), "  ").alias("history"))
    both = h.join(shown, "imp")
    _lines(both, path, F.col("imp").cast("string"), F.concat(F.lit("U"), F.col("usr")), F.date_format(F.timestamp_micros("t"), TIME), "history", "shown")


def read_news(spark, sf):
    path = folder(spark)
    _news(spark, sf, path)
    return readers.mind_news(spark, path).select("dataset", "article_id", "category", _text("subcategory"), "title", "abstract", _text("entities"), F.col("published_time").isNull().alias("no_time"))


def read_behaviors(spark, sf):
    path = folder(spark)
    _behaviors(spark, sf, path)
    return readers.mind_behaviors(spark, path, "train").select("raw_split", "impression_id", "user_id", F.unix_micros("time").alias("t"), _text("history"), _text("candidates"), _text("labels"))


def read_test_behaviors(spark, sf):
    path = folder(spark)
    _behaviors(spark, sf, path, labels=False)
    return readers.mind_test_behaviors(spark, path).select("impression_id", "user_id", F.unix_micros("time").alias("t"), _text("history"), _text("candidates"))


def read_periods(spark, sf):
    """Two periods' folders: an article of both is the first's; behaviors of both."""
    path = folder(spark)
    for period, where, mark in (("train", "p_partkey % 3 < 2", "a "), ("dev", "p_partkey % 3 > 0", "b ")):
        _news(spark, sf, f"{path}/{period}/news.tsv", where, mark)
        _behaviors(spark, sf, f"{path}/{period}/behaviors.tsv")
    articles, behaviors = readers.mind(spark, f"{path}/train", f"{path}/dev")
    n = behaviors.groupBy().agg(F.count("*").alias("behaviors"), F.countDistinct("raw_split", "impression_id").alias("distinct_behaviors"))
    return articles.select("article_id", "title").crossJoin(F.broadcast(n))


def read_catalogue(spark, sf):
    path = folder(spark)
    _news(spark, sf, path)
    return readers.mind_catalogue(spark, path)


def _articles(spark, sf, path: str) -> None:
    """Every fifth article has no time of publication, every third no subtitle."""
    p = A.table(spark, sf, "part")
    time = F.when(F.col("p_partkey") % 5 != 0, F.timestamp_micros(F.lit(700_000_000_000_000) + F.col("p_partkey") * 86_400_000_000))
    subtitle = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    p.select(
        F.col("p_partkey").cast("int").alias("article_id"), F.col("p_name").alias("title"), subtitle.alias("subtitle"), F.lit(None).cast("string").alias("body"), F.col("p_brand").alias("category_str"),
        F.array("p_size").alias("subcategory"), time.alias("published_time"), F.array("p_brand", "p_type").alias("ner_clusters"),
    ).write.parquet(path)


def read_articles(spark, sf):
    path = folder(spark)
    _articles(spark, sf, path)
    return readers.ebnerd_articles(spark, path).select("dataset", "article_id", "title", "abstract", "body", "category", _text("subcategory"), F.unix_micros("published_time").alias("published"), _text("entities", "|"))


def read_article_texts(spark, sf):
    path = folder(spark)
    _articles(spark, sf, path)
    return readers.ebnerd_catalogue(spark, path)


def read_history_join(spark, sf):
    """Impressions with histories from a file of their own, in which users repeat; the outcome's columns are there, and not read."""
    path = folder(spark)
    s = A.shown(spark, sf).groupBy("imp", "usr", "t").agg(F.sort_array(F.collect_list(F.struct("pos", "art", "label"))).alias("s"))
    s.select(
        F.col("imp").alias("impression_id"), F.col("usr").alias("user_id"), F.timestamp_micros("t").alias("impression_time"), (F.col("imp") % 7).alias("session_id"), F.transform("s", lambda x: x["art"]).alias("article_ids_inview"),
        F.transform(F.filter("s", lambda x: x["label"] == 1), lambda x: x["art"]).alias("article_ids_clicked"), F.lit(9.0).alias("read_time"), F.lit(1.0).alias("scroll_percentage"), F.lit(2.0).alias("next_read_time"),
    ).write.parquet(f"{path}/behaviors")
    h = A.histories(spark, sf).where("size(history) > 0").select("usr", "t", "history").groupBy("usr", "t").agg(F.first("history").alias("h"))
    h.select(
        F.col("usr").alias("user_id"), F.transform("h", lambda x: x["art"]).alias("article_id_fixed"), F.transform("h", lambda x: x["dwell"]).alias("read_time_fixed"),
        F.transform("h", lambda x: F.timestamp_micros(x["t"])).alias("impression_time_fixed"),
    ).write.parquet(f"{path}/history")
    out = readers.ebnerd_behaviors(spark, f"{path}/behaviors", f"{path}/history", "dev")
    leaks = F.lit(len({"read_time", "scroll_percentage", "next_read_time"} & set(out.columns))).cast("long").alias("leaks")
    return out.select("raw_split", "impression_id", "user_id", F.unix_micros("time").alias("t"), "session_id", _text("history"), F.size(F.filter("history_read_time", lambda x: x.isNotNull())).cast("long").alias("n_read"),
                      F.unix_micros(F.get("history_impression_time", F.size("history_impression_time") - 1)).alias("last_click"), _text("candidates"), _text("labels"), leaks)


def freshness_reference(spark, sf):
    """Ages by both definitions: first display, and time of publication; each only where it is before the impression."""
    from ..functions.scalars import log_hours

    path = folder(spark)
    _articles(spark, sf, path)
    published = readers.ebnerd_catalogue(spark, path).select(F.col("article_id").cast("long").alias("art"), "published")
    s = A.shown(spark, sf).select("imp", "art", "t").distinct()
    seen, out = stats.reference_times(s).withColumnRenamed("first_t", "seen"), stats.reference_times(s, published).withColumnRenamed("first_t", "out")
    r = lambda c: F.round(log_hours(F.col(c), F.col("t")), 6)
    return s.join(seen, "art", "left").join(out, "art", "left").select("imp", "art", r("seen").alias("since_seen"), r("out").alias("since_published"))


def count_impressions(spark, sf):
    """The two counts: of a parquet table and of a file of lines."""
    path = folder(spark)
    _behaviors(spark, sf, f"{path}/lines")
    A.orders(spark, sf).write.parquet(f"{path}/orders.parquet")
    return spark.createDataFrame([(readers.count_rows(spark, f"{path}/orders.parquet"), readers.count_rows(spark, f"{path}/lines"))], "table_rows long, line_rows long")


def partitioned_table(spark, sf):
    """A table written by split and read back with the split as a filter on folders."""
    path = folder(spark)
    sinks.write_table(A.split_of(A.orders(spark, sf)), path, "split")
    return spark.read.parquet(path).where("split = 'val'").select("imp", "usr", "t")


def submission_archive(spark, sf):
    """The archive's lines, in its order, after a run that was stopped half-way and taken up again."""
    from .ranking import _test

    path = folder(spark)
    ranked = metrics.submission(_test(spark, sf))
    sinks.write_submission(ranked, path, "mind", parts=4, group=2, stop_after=2)
    archive = sinks.write_submission(ranked, path, "mind", parts=4, group=2)
    lines = sinks.archive_lines(spark, archive, "mind")
    return lines.select((F.col("line") + 1).alias("line"), "value")


QUERIES = {f.__name__: f for f in (
    read_news, read_behaviors, read_test_behaviors, read_periods, read_catalogue, read_articles, read_article_texts, read_history_join, freshness_reference, count_impressions, partitioned_table, submission_archive,
)}

_ABSTRACT = "case when p_size % 3 = 0 then '' else p_type end"
_SHOWN = "sl as (select imp, string_agg('N' || art, ' ' order by pos) candidates, string_agg(cast(label as varchar), ' ' order by pos) labels from shown group by imp)"
_HIST = "hl as (select imp, string_agg('N' || art, ' ' order by i) history from hist group by imp)"
_LOG = ctes("orders", "shown", "history") + f", {_SHOWN}, {_HIST}"
_PUBLISHED = "case when p_partkey % 5 <> 0 then 700000000000000 + p_partkey * 86400000000 end"
ORACLES = {
    "read_news": f"select 'mind' dataset, 'N' || p_partkey article_id, p_brand category, p_type subcategory, '\"' || p_name title, {_ABSTRACT} abstract, p_brand || case when p_size % 2 = 0 then '' else ' x' end entities, true no_time from part",
    "read_behaviors": _LOG + " select 'train' raw_split, cast(imp as varchar) impression_id, 'U' || usr user_id, t, coalesce(history, '') history, candidates, labels from ord join sl using (imp) left join hl using (imp)",
    "read_test_behaviors": _LOG + " select cast(imp as varchar) impression_id, 'U' || usr user_id, t, coalesce(history, '') history, candidates from ord join sl using (imp) left join hl using (imp)",
    "read_periods": ctes("orders", "shown") + ", n as (select count(distinct imp) n from shown) select 'N' || p_partkey article_id, case when p_partkey % 3 < 2 then '\"a ' else '\"b ' end || p_name title, 2 * n behaviors, 2 * n distinct_behaviors from part, n",
    "read_catalogue": f"select 'N' || p_partkey article_id, trim('\"' || p_name || ' ' || {_ABSTRACT}) as text from part",
    "read_articles": f"select 'ebnerd' dataset, cast(p_partkey as varchar) article_id, p_name title, {_ABSTRACT} abstract, '' body, p_brand category, cast(p_size as varchar) subcategory, {_PUBLISHED} published, p_brand || '|' || p_type entities from part",
    "read_article_texts": f"select cast(p_partkey as varchar) article_id, trim(p_name || ' ' || {_ABSTRACT} || ' ') as text, {_PUBLISHED} published from part",
    "read_history_join": ctes("orders", "shown", "history") + """, im as (select imp, usr, t, string_agg(cast(art as varchar), ' ' order by pos) candidates, string_agg(cast(l as varchar), ' ' order by pos) labels
      from (select *, max(label) over (partition by imp, art) l from shown) group by imp, usr, t),
    us as (select usr, max(t) t from hist group by usr), one as (select usr, min(imp) imp from hist join us using (usr, t) group by usr),
    hh as (select h.usr, string_agg(cast(art as varchar), ' ' order by i) history, count(dwell) n_read, max(ct) last_click from hist h join one on h.imp = one.imp group by h.usr)
    select 'dev' raw_split, cast(im.imp as varchar) impression_id, cast(im.usr as varchar) user_id, im.t, cast(im.imp % 7 as varchar) session_id, coalesce(history, '') history, coalesce(n_read, 0) n_read, last_click, candidates, labels, cast(0 as bigint) leaks
    from im left join hh on im.usr = hh.usr""",
    "freshness_reference": ctes("orders", "shown") + f""", s as (select distinct imp, art, t from shown), f as (select art, min(t) seen from s group by art), p as (select p_partkey art, {_PUBLISHED} pub from part)
    select imp, s.art, round(case when seen < t then ln(1 + (t - seen) / 3600000000.0) end, 6) since_seen, round(case when pub < t then ln(1 + (t - pub) / 3600000000.0) end, 6) since_published from s join f using (art) left join p on p.art = s.art""",
    "count_impressions": "select (select count(*) from orders) table_rows, (select count(distinct o_orderkey) from lineitem join orders on l_orderkey = o_orderkey) line_rows",
    "partitioned_table": ctes("orders", "cut", "osplit") + " select imp, usr, t from osp where split = 'val'",
}
from .ranking import _FIRST  # noqa: E402

ORACLES["submission_archive"] = f"""{_FIRST}, r as (select imp, pos, row_number() over (partition by imp order by score desc, pos) r from te), l as (select imp, imp || ' [' || string_agg(cast(r as varchar), ',' order by pos) || ']' as value from r group by imp)
select row_number() over (order by imp) line, value from l"""
