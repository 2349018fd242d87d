"""Queries: reports of one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import draw_sql
from ..operators import reports, stats
from ..sources import adapters as A
from ..sources.adapters import ctes
from .ranking import _FIRST, _interval, _test, _weights

r6 = lambda c: F.round(F.col(c), 6).alias(c)


def age_report(spark, sf):
    """First sightings as references; an article's publication is taken to be up to 71 hours earlier."""
    s = A.shown(spark, sf)
    seen = stats.first_seen(s).select("art", F.col("first_t").alias("ref"))
    truth = seen.select("art", (F.col("ref") - F.col("art") % 72 * config.MICROS_HOUR).alias("ref"))
    out = reports.age_signal(s.select("imp", "pos", "art", "t", "label"), seen, A.orders(spark, sf), truth)
    return out.select(*(r6(c) if kind == "double" else c for c, kind in out.dtypes))


def beyond_report(spark, sf):
    """All impressions of the test split, ranked by their articles' clicks in training."""
    test = _test(spark, sf)
    counts = stats.article_counts(A.split_of(A.shown(spark, sf), A.orders(spark, sf)).where("split = 'train'"))
    total = counts.agg(F.sum("click_count").alias("n")).first()["n"] or 0
    m = A.table(spark, sf, "embeddings").count()
    scored = test.select("imp", "pos", "art", "score")
    out = reports.beyond_accuracy(scored, A.vectors(spark, sf), F.pmod(F.col("art"), F.lit(m)), stats.click_probabilities(counts), F.lit(1.0 / (total + 1)), A.catalogue(spark, sf).count())
    return out.select(*(r6(c) if kind == "double" else c for c, kind in out.dtypes))


QUERIES = {f.__name__: f for f in (age_report, beyond_report)}

_POINT = "(select count(distinct art) / any_value(c) p from r, size)"
ORACLES = {
    "age_report": ctes("orders", "shown") + f""", seen as (select art, min(t) ref from shown group by art), start as (select min(t) start from ord),
d as (select imp, pos, label, ref <= start + {config.MICROS_HOUR} early, case when ref < t then (t - ref) / {config.MICROS_HOUR}.0 end h,
  case when ref - art % 72 * {config.MICROS_HOUR} < t then (t - ref + art % 72 * {config.MICROS_HOUR}) / {config.MICROS_HOUR}.0 end th from shown join seen using (art), start),
w as (select imp from d group by imp having count(*) = count(h)),
auc as (select a.imp, avg(case when a.h < b.h then 1.0 when a.h = b.h then 0.5 else 0.0 end) auc from d a join d b on a.imp = b.imp and a.label = 1 and b.label = 0 join w on a.imp = w.imp group by a.imp),
sd as (select stddev_pop(h) sd from d group by imp having count(h) > 1)
select count(*) n_candidates, round(avg(cast(h is not null as int)), 6) dated, round(count(h) filter (label = 1) / sum(label), 6) clicks_dated,
  round(quantile_cont(round(h, 1), 0.5) filter (label = 1), 6) median_clicked, round(quantile_cont(round(h, 1), 0.5) filter (label = 0), 6) median_other,
  round(count(h) filter (early) / greatest(count(h), 1), 6) censored, round(quantile_cont(round(th - h, 1), 0.5), 6) median_gap, round(avg(cast(th - h > 24 as int)), 6) gap_over_day,
  round(quantile_cont(round(th, 1), 0.5) filter (early and h is not null), 6) censored_true_age, (select round(quantile_cont(round(sd, 1), 0.5), 6) from sd) median_spread,
  (select round(avg(auc), 6) from auc) freshest_first_auc, (select count(*) from auc) n_freshest_first from d""",
    "beyond_report": f"""{_FIRST}, {ctes('vectors')[5:]}, m as (select count(*) m from embeddings), size as (select count(*) c from part),
r as (select imp, pos, art, art % m v from te, m qualify row_number() over (partition by imp order by score desc, pos) <= 10),
re as (select r.*, e from r left join vec on v = vec), ls as (select distinct imp id, 0 x from r),
vd as (select a.imp id, 1 - avg(list_dot_product(a.e, b.e)) x from re a join re b on a.imp = b.imp and a.pos < b.pos group by a.imp),
c as (select art, sum(label) c from sp where split = 'train' group by art having sum(label) > 0), n as (select sum(c) n from c),
vn as (select imp id, avg(-log2(coalesce(c / n, 1 / (n + 1)))) x from r left join c using (art), n group by imp),
co as (select rep, count(distinct art) / any_value(c) c from {_weights('ls', config.BOOTSTRAP_DRAWS)} join r on id = imp, size where w > 0 group by rep),
nu as (select row_number() over (order by vec) i, e from vec),
dr as (select {draw_sql(config.SEED, 'k', '0')} % m + 1 i, {draw_sql(config.SEED, 'k', '1')} % m + 1 j from range(4000) t(k), m),
rd as (select 1 - avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))) rd from dr join nu a on dr.i = a.i join nu b on dr.j = b.i where dr.i <> dr.j)
select (select count(*) from ls) n_impressions, cast(10 as bigint) top_k, (select c from size) catalogue_size, diversity, diversity_lo, diversity_hi, novelty, novelty_lo, novelty_hi,
  round(p, 6) coverage, round((select quantile_cont(co.c, 0.025) - avg(co.c) from co) + p, 6) coverage_lo, round((select quantile_cont(co.c, 0.975) - avg(co.c) from co) + p, 6) coverage_hi,
  round(rd, 6) random_diversity, round((select avg(x) from vd) / rd, 6) diversity_vs_random
from (select {_interval('vd')}) a(n1, diversity, diversity_lo, diversity_hi), (select {_interval('vn')}) b(n2, novelty, novelty_lo, novelty_hi), {_POINT}, rd""",
}
