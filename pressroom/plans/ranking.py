"""Queries: labels, samples, the feature matrix, metrics, models, submissions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions.scalars import draw_sql
from ..operators import beyond, codec, features, impressions, metrics, sampling, stats
from ..schemas import FEATURES
from ..sources import adapters as A
from ..sources import sinks
from ..sources.adapters import ctes
from ..sources.shared import Grouped, stored

r6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)
r9 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 9)


def _first(spark, sf):
    """A first stage on orders: candidates by clicks of the training split; scores tie often. imp, pos, art, label, score, t, usr."""
    s = A.split_of(A.shown(spark, sf), A.orders(spark, sf))
    pop = stats.article_counts(s.where("split = 'train'")).select("art", "click_count")
    return s.join(pop, "art", "left").withColumn("score", F.coalesce("click_count", F.lit(0)).cast("double"))


def _test(spark, sf):
    return _first(spark, sf).where("split = 'test'")


def label_candidates(spark, sf):
    """Users' 20 best known articles as candidates of their impressions: a click on an article that wasn't shown counts, too."""
    s = A.shown(spark, sf)
    top = stats.popularity(s, top=20).select("art", "rank")
    clicked = s.where("label = 1").select("imp", "art").distinct().withColumn("hit", F.lit(1))
    out = A.orders(spark, sf).select("imp").crossJoin(F.broadcast(top)).join(clicked, ["imp", "art"], "left")
    return out.select("imp", "art", "rank", F.coalesce("hit", F.lit(0)).alias("label"))


def positive_impressions(spark, sf):
    s = A.shown(spark, sf)
    return s.join(s.where("label = 1").select("imp").distinct(), "imp", "left_semi").groupBy("imp").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("clicks"))


def drop_no_click(spark, sf):
    lists = A.shown(spark, sf).groupBy("imp").agg(F.collect_list("label").alias("labels"))
    return lists.where(F.exists("labels", lambda x: x == 1)).select("imp", F.size("labels").cast("bigint").alias("n"))


def sampled_rows(spark, sf):
    return sampling.fraction(A.orders(spark, sf), "imp", 0.1).select("imp", "usr")


def sampled_fixed(spark, sf):
    return sampling.fixed(A.orders(spark, sf), "imp", 500).select("imp", "usr")


def request_block(spark, sf):
    return sampling.middle(A.orders(spark, sf), 1000).select("imp", "t")


def negatives_sampled(spark, sf):
    c = A.shown(spark, sf).withColumn("rank", F.col("pos"))
    return sampling.negatives(c, config.NEGATIVES_HARD, config.NEGATIVES_RANDOM).select("imp", "pos", "art", "label")


def wu_sampling(spark, sf):
    out = sampling.wu(A.shown(spark, sf))
    return out.select("imp", "pos", F.array_join(F.col("candidates").cast("array<string>"), " ").alias("candidates"), "label")


def _matrix(spark, sf):
    """imp, art, the features, label: of the candidates of all splits."""
    # Stored once, with what groups by impression say: the rows lie by impression there, so it takes no exchange.
    imp, one = Window.partitionBy("imp"), Window.partitionBy("imp", "art")
    s = A.split_of(A.shown(spark, sf, dwell=True), A.orders(spark, sf)).withColumn("clicks", F.sum("label").over(imp))
    s = s.withColumns({"place": F.row_number().over(one.orderBy("pos")), "rank": F.min("pos").over(one).cast("bigint"), "best": F.max("label").over(one)})
    s = stored(s)
    n = A.table(spark, sf, "embeddings").count()
    cand = s.where("place = 1").select("imp", "art", "t", "rank", F.col("best").alias("label"), (F.lit(1.0) / F.col("rank")).alias("score"))
    clicks = s.where("pos = 1").select("imp", "clicks")
    log = A.split_of(A.orders(spark, sf)).join(clicks, "imp", "left").fillna(0, ["clicks"])
    own = A.histories(spark, sf, log=s).select("imp", "t", "history")
    return features.build(s.select("art", "t", "label"), own, cand, s.where("split = 'train'"), A.catalogue(spark, sf), A.vectors(spark, sf), lambda a: F.pmod(a, F.lit(n)), log)


def feature_matrix(spark, sf):
    out = _matrix(spark, sf)
    kinds = dict(out.dtypes)
    cols = [r6(c).alias(c) if kinds[c] == "double" else F.col(c).cast("bigint").alias(c) for c in FEATURES]
    return out.select("imp", "art", *cols, "label")


def recall_fraction(spark, sf):
    """The 200 articles most clicked in training, against the test's clicks."""
    s = A.split_of(A.shown(spark, sf), A.orders(spark, sf))
    top = stats.popularity(s.where("split = 'train'"), top=200).agg(F.collect_list("art").alias("candidates"))
    test = s.where("split = 'test'")
    clicked = test.where("label = 1").groupBy("imp").agg(F.collect_set("art").alias("clicked"))
    return metrics.recall(test.select("imp").distinct().crossJoin(F.broadcast(top)), clicked).select(r6("recall").alias("recall"))


def hit_rate(spark, sf):
    s = A.split_of(A.shown(spark, sf), A.orders(spark, sf))
    top = stats.popularity(s.where("split = 'train'"), top=200).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "art"))), lambda x: x["art"]).alias("candidates"))
    all_ = A.split_of(A.orders(spark, sf)).where("split = 'test'").select("imp")
    clicked = s.where("split = 'test' and label = 1").groupBy("imp").agg(F.collect_set("art").alias("clicked"))
    out = [metrics.hit_rate(all_.crossJoin(F.broadcast(top)), clicked, k, all_).select(F.lit(k).cast("bigint").alias("k"), r6("hit_rate").alias("hit_rate")) for k in (50, 100, 200)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _per(spark, sf):
    return metrics.per_impression(_test(spark, sf).select("imp", "pos", "score", "label"))


def auc_per_impression(spark, sf):
    return _per(spark, sf).select("imp", r6("auc").alias("auc"))


def mrr(spark, sf):
    return _per(spark, sf).select("imp", r6("mrr").alias("mrr"))


def ndcg_at_k(spark, sf):
    return _per(spark, sf).select("imp", r6("ndcg_5").alias("ndcg_5"), r6("ndcg_10").alias("ndcg_10"))


def metrics_population(spark, sf):
    all_ = A.split_of(A.orders(spark, sf)).where("split = 'test'").select("imp")
    out = metrics.population(_per(spark, sf), all_)
    return out.select("n_impressions", "n_scored", *(r6(c).alias(c) for c in ("auc", "mrr", "ndcg_5", "ndcg_10")))


def before_after(spark, sf):
    """Before: minus the place; after: the score."""
    t = _test(spark, sf)
    b = metrics.per_impression(t.select("imp", "pos", (-F.col("pos")).cast("double").alias("score"), "label"))
    a = metrics.per_impression(t.select("imp", "pos", "score", "label"))
    f = lambda d, x: d.agg(*(r6(F.avg(c)).alias(f"{x}_{c}") for c in ("auc", "mrr", "ndcg_5", "ndcg_10")))
    return f(b, "before").crossJoin(f(a, "after"))


def slice_cold_warm(spark, sf):
    h = A.split_of(A.histories(spark, sf), A.orders(spark, sf)).where("split = 'test'").select("imp", F.when(F.size("history") <= 5, "cold_start").otherwise("warm").alias("slice"))
    return metrics.population(_per(spark, sf), h, "slice").select("slice", "n_impressions", "n_scored", *(r6(c).alias(c) for c in ("auc", "mrr", "ndcg_5", "ndcg_10")), (F.col("n_impressions") < 30).alias("small"))


def slice_head_tail(spark, sf):
    s = A.split_of(A.shown(spark, sf), A.orders(spark, sf))
    head = stats.head_set(stats.article_counts(s.where("split = 'train'")), 0.2).withColumn("head", F.lit(True))
    first = s.where("split = 'test' and label = 1").groupBy("imp").agg(F.min_by("art", "pos").alias("art"))
    slices = first.join(head, "art", "left").select("imp", F.when(F.col("head"), "head").otherwise("tail").alias("slice"))
    return metrics.population(_per(spark, sf), slices, "slice").select("slice", "n_impressions", "n_scored", *(r6(c).alias(c) for c in ("auc", "mrr", "ndcg_5", "ndcg_10")))


def novelty(spark, sf):
    s = stored(A.split_of(A.shown(spark, sf), A.orders(spark, sf)).where("split in ('train', 'test')").select("imp", "art", "label", "split"))  # used twice
    counts = stored(stats.article_counts(s.where("split = 'train'")))  # used three times
    lists = s.where("split = 'test'").groupBy("imp").agg(F.collect_list("art").alias("arts"))
    total = counts.agg(F.sum("click_count").alias("n")).first()["n"] or 0
    return beyond.novelty(lists, stats.click_probabilities(counts), F.lit(1.0 / (total + 1))).select("imp", r6("novelty").alias("novelty"))


def paired_predictions(spark, sf):
    t = stored(_test(spark, sf).select("imp", "pos", "score", "label"))  # both arms
    base = t.select("imp", "pos", (-F.col("pos")).cast("double").alias("score"), "label")
    return metrics.paired(base, t.select("imp", "pos", "score", "label")).groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("arm_score") > 0).cast("bigint")).alias("known"))


def rank_submission(spark, sf):
    return metrics.submission(_test(spark, sf)).select("impression_id", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"))


def submission_lines(spark, sf):
    return sinks.ranked_lines(metrics.submission(_test(spark, sf)))


def verify_submission(spark, sf):
    ranked = metrics.submission(_test(spark, sf))
    return ranked.agg(F.count("*").alias("rows")).crossJoin(sinks.bad_ranks(ranked).agg(F.count("*").alias("bad")))


def log_window(spark, sf):
    """The log around the test split, with 24 hours before it."""
    o = A.split_of(A.orders(spark, sf))
    lo = o.where("split = 'test'").agg(F.min("t"), F.max("t")).first()
    day = 86_400_000_000
    return o.where(F.col("t").between(lo[0] - day, lo[1])).select("imp", "t", (F.col("split") == "test").alias("is_target"))


def bootstrap_ci(spark, sf):
    out = beyond.bootstraps(_per(spark, sf).withColumnRenamed("imp", "id"), ["auc", "mrr", "ndcg_10"])
    return out.select("metric", "n", *(r6(c).alias(c) for c in ("mean", "lo", "hi")))


def paired_bootstrap(spark, sf):
    t = _test(spark, sf)
    b = metrics.per_impression(t.select("imp", "pos", (-F.col("pos")).cast("double").alias("score"), "label")).select(F.col("imp").alias("id"), F.col("mrr").alias("x"))
    out = beyond.paired_bootstrap(b, _per(spark, sf).select(F.col("imp").alias("id"), F.col("mrr").alias("x")))
    return out.select("n", r6("mean").alias("mean"), r6("lo").alias("lo"), r6("hi").alias("hi"), "wins", "ties", "losses")


def coverage_ci(spark, sf):
    lists = _test(spark, sf).groupBy("imp").agg(F.collect_list("art").alias("arts"))
    return beyond.coverage_bootstrap(lists, A.catalogue(spark, sf).count()).select(*(F.round(c, 8).alias(c) for c in ("coverage", "lo", "hi")))


def random_pair_diversity(spark, sf):
    return beyond.random_pair_diversity(A.vectors(spark, sf)).select("pairs", r6("diversity").alias("diversity"))


def _ranker_matrix(spark, sf):
    """The feature matrix as the ranker reads it: imp, row (the first stage's rank), split, label, FEATURES as numbers."""
    splits = A.split_of(A.orders(spark, sf)).select("imp", "split")
    m = _matrix(spark, sf)
    kinds = dict(m.dtypes)
    return m.select("imp", F.col("retrieval_rank").alias("row"), "label", *(F.col(c).cast("double").alias(c) if kinds[c] == "boolean" else F.col(c) for c in FEATURES)).join(splits, "imp")


def lambdamart_scores(spark, sf):
    """The ranker on all features, trained on the training split, stopped on val, scored on test."""
    from ..models import run

    out, _ = run.scored(stored(_ranker_matrix(spark, sf)))
    return out.select("imp", "pos", "label", r9("score").alias("score"))


def ranker_arms(spark, sf):
    """The ablation's arms of features, each trained and tested on the same rows."""
    from ..models import run

    return run.arms(_ranker_matrix(spark, sf))


def _split_rows(spark, sf):
    """The training split with features that SQL can bin: place, earlier clicks of the article, reading time (unknown for some)."""
    s = A.split_of(A.shown(spark, sf, dwell=True), A.orders(spark, sf)).where("split = 'train'")
    clicks = s.groupBy("art").agg(F.sum("label").alias("clicks"))
    return s.join(clicks, "art").select("imp", F.col("pos").alias("row"), "label", F.lit(0.0).alias("score"), F.col("pos").cast("double").alias("place"), F.col("clicks").cast("double").alias("clicks"), "dwell")


_SPLIT_FEATURES, _SPLIT_LEAVES = ["place", "clicks", "dwell"], 4


def lambdamart_gradients(spark, sf):
    from ..models import lambdamart

    rows = A.split_of(A.shown(spark, sf), A.orders(spark, sf)).where("split = 'train'").select("imp", F.col("pos").alias("row"), "label", (1 / F.col("pos")).alias("score"))
    return lambdamart.lambdas(rows).select("imp", "row", r6("g").alias("g"), r6("h").alias("h"))


def lambdamart_first_tree(spark, sf):
    """The first tree's splits, with edges at whole numbers."""
    from ..models import lambdamart, trees

    edges = [[float(x) for x in range(trees.BINS - 1)]] * len(_SPLIT_FEATURES)
    rows = stored(trees.binned(lambdamart.lambdas(_split_rows(spark, sf)), _SPLIT_FEATURES, edges))
    tree = trees.grow(rows, len(_SPLIT_FEATURES), leaves=_SPLIT_LEAVES)
    found = [(_SPLIT_FEATURES[x.feature], x.bin, x.missing_left, x.gain, x.n) for x in tree.nodes if x.feature >= 0]
    out = spark.createDataFrame(found, "feature string, bin int, missing_left boolean, gain double, n long")
    return out.withColumn("gain", F.round("gain", 4))


def grouped_matrix(spark, sf):
    """Impressions' rows as a grouped table keeps them: their number, whether they lie together, and the articles in the order they lie in."""
    tables = Grouped(spark, "imp", int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = tables.store(A.shown(spark, sf).select("imp", "pos", "art", "label"), "pos").withColumn("i", F.monotonically_increasing_id())
    lists = rows.groupBy("imp").agg(F.count("*").alias("n"), (F.max("i") - F.min("i") + 1 == F.count("*")).alias("together"), F.sort_array(F.collect_list(F.struct("i", "art"))).alias("s"))
    return lists.select("imp", "n", "together", F.array_join(F.transform("s", lambda x: x["art"].cast("string")), " ").alias("arts"))


def ranker_report(spark, sf):
    """Before and after, with popularity's scores for the second stage."""
    from ..models import run

    t = _test(spark, sf).withColumn("retrieval_rank", F.col("pos"))
    impressions = A.split_of(A.orders(spark, sf)).where("split = 'test'").select("imp")
    out = run.report(t.select("imp", "pos", "label", "score", "retrieval_rank"), impressions)
    return out.select("stage", "n_impressions", "n_scored", *(r6(c).alias(c) for c in ("auc", "mrr", "ndcg_5", "ndcg_10", "recall", "captured")))


def nrms_scores(spark, sf):
    """The neural ranker with seeded weights over titles of the catalogue."""
    from ..models import nrms

    vocabulary = 5000
    codes = codec.codec(A.catalogue(spark, sf).select("art"))
    tokens = codec.encode(codec.token_codes(A.catalogue(spark, sf), config.TITLE_TOKENS, vocabulary), codes).select("code", "tokens")
    w = nrms.Weights.seeded(vocabulary)
    v = nrms.article_vectors(tokens, w)
    from ..functions.scalars import padded

    h = codec.encode(A.histories(spark, sf).select("imp", F.posexplode_outer("history").alias("i", "h")).select("imp", "i", F.col("h.art").alias("art")), codes)
    h = h.groupBy("imp").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.col("code").cast("int").alias("c"))))), lambda x: x["c"]).alias("h"))
    c = codec.encode(A.shown(spark, sf).select("imp", "pos", "art"), codes).groupBy("imp").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("code").cast("int").alias("c")))), lambda x: x["c"]).alias("candidates"))
    return nrms.scores(h.select("imp", padded(F.col("h"), config.HISTORY_LENGTH).alias("history")).join(c, "imp"), v, w).select("imp", "pos", "code", r6("score").alias("score"))


QUERIES = {f.__name__: f for f in (
    label_candidates, positive_impressions, drop_no_click, sampled_rows, sampled_fixed, request_block, negatives_sampled, wu_sampling, feature_matrix, recall_fraction, hit_rate, auc_per_impression, mrr, ndcg_at_k, metrics_population,
    before_after, slice_cold_warm, slice_head_tail, novelty, paired_predictions, rank_submission, submission_lines, verify_submission, log_window, bootstrap_ci, paired_bootstrap, coverage_ci, random_pair_diversity, lambdamart_scores, nrms_scores,
    ranker_arms, lambdamart_gradients, lambdamart_first_tree, grouped_matrix, ranker_report,
)}

_TRAIN = ctes("orders", "shown", "cut", "split", "osplit")
_FIRST = f"{_TRAIN}, pop as (select art, cast(sum(label) as double) score from sp where split = 'train' group by art), fs as (select sp.*, coalesce(score, 0.0) score from sp left join pop using (art)), te as (select * from fs where split = 'test')"


def _metrics(score: str = "score", name: str = "") -> str:
    r = f"r{name} as (select imp, label, row_number() over (partition by imp order by {score} desc, pos desc) r, row_number() over (partition by imp order by label desc, pos) i, rank() over (partition by imp order by {score}) + (count(*) over (partition by imp, {score}) - 1) / 2 a from te)"
    d = lambda at, k: f"sum(case when {at} <= {k} then (pow(2, label) - 1) / log2({at} + 1) else 0.0 end)"
    n = ", ".join(f"case when {d('i', k)} > 0 then {d('r', k)} / {d('i', k)} else 0.0 end ndcg_{k}" for k in (5, 10))
    return f"{r}, pe{name} as (select imp, case when sum(label) > 0 and sum(1 - label) > 0 then (sum(a * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) end auc, case when sum(label) > 0 then sum(label / r) / sum(label) else 0.0 end mrr, {n} from r{name} group by imp)"


_M = f"{_FIRST}, {_metrics()}"
_MEANS = "count(*) n_impressions, count(mrr) n_scored, round(avg(auc), 6) auc, round(avg(coalesce(mrr, 0)), 6) mrr, round(avg(coalesce(ndcg_5, 0)), 6) ndcg_5, round(avg(coalesce(ndcg_10, 0)), 6) ndcg_10"
_TOP = "pop2 as (select art, row_number() over (order by sum(label) desc, art) rank from sp where split = 'train' group by art qualify rank <= 200)"
_HEAD = "hd as (select art from (select art, sum(label) c from sp where split = 'train' group by art) qualify row_number() over (order by c desc, art) <= greatest(1, cast(floor(0.2 * count(*) over ()) as bigint)))"
_D = lambda *p: draw_sql(42, *p)
ORACLES = {
    "label_candidates": ctes("orders", "shown") + ", tp as (select art, row_number() over (order by sum(label) desc, art) rank from shown group by art qualify rank <= 20), ck as (select distinct imp, art from shown where label = 1) select o.imp, tp.art, rank, cast(ck.art is not null as int) label from ord o, tp left join ck on ck.imp = o.imp and ck.art = tp.art",
    "positive_impressions": ctes("orders", "shown") + " select imp, count(*) n, cast(sum(label) as bigint) clicks from shown group by imp having sum(label) > 0",
    "drop_no_click": ctes("orders", "shown") + " select imp, count(*) n from shown group by imp having max(label) = 1",
    "sampled_rows": ctes("orders") + f" select imp, usr from ord where {_D('imp')} % 1000000 < 100000",
    "sampled_fixed": ctes("orders") + f" select imp, usr from ord order by {_D('imp')}, imp limit 500",
    "request_block": ctes("orders") + " select imp, t from ord order by t, imp limit 1000 offset (select (count(*) - 1000) // 2 from orders)",
    "negatives_sampled": ctes("orders", "shown") + f", h as (select *, row_number() over (partition by imp, label order by pos, art) h from shown), r as (select *, row_number() over (partition by imp, label, (label = 0 and h <= {config.NEGATIVES_HARD}) order by {_D('imp', 'art')}, pos, art) r from h) select imp, pos, art, label from r where label = 1 or h <= {config.NEGATIVES_HARD} or r <= {config.NEGATIVES_RANDOM}",
    "wu_sampling": ctes("orders", "shown") + f", no as (select imp, list(art order by pos) no from shown where label = 0 group by imp), p as (select imp, pos, art, no, unnest(range(0, 5)) i from shown join no using (imp) where label = 1), c as (select imp, pos, i, case when i = 0 then art else no[{_D('imp', 'pos', 'i')} % len(no) + 1] end a, {draw_sql(43, 'imp', 'pos', 'i')} d from p) select imp, pos, string_agg(cast(a as varchar), ' ' order by d, i) candidates, cast(list_position(list(i order by d, i), 0) - 1 as bigint) as label from c group by imp, pos",
    "recall_fraction": f"{_TRAIN}, {_TOP}, ck as (select distinct imp, art from sp where split = 'test' and label = 1), f as (select imp, count(pop2.art) / count(*) f from ck left join pop2 using (art) group by imp) select round(avg(f), 6) recall from f",
    "hit_rate": f"{_TRAIN}, {_TOP}, ck as (select imp, min(rank) b from sp join pop2 using (art) where split = 'test' and label = 1 group by imp), k as (select unnest([50, 100, 200]) k) select cast(k as bigint) k, round(avg(cast(coalesce(b <= k, false) as int)), 6) hit_rate from k, osp left join ck on osp.imp = ck.imp where osp.split = 'test' group by k",
    "auc_per_impression": f"{_M} select imp, round(auc, 6) auc from pe",
    "mrr": f"{_M} select imp, round(mrr, 6) mrr from pe",
    "ndcg_at_k": f"{_M} select imp, round(ndcg_5, 6) ndcg_5, round(ndcg_10, 6) ndcg_10 from pe",
    "metrics_population": f"{_M} select {_MEANS} from osp left join pe using (imp) where split = 'test'",
    "before_after": f"{_M}, {_metrics('-pos', '0')} select " + ", ".join(f"(select round(avg({c}), 6) from pe{x}) {y}_{c}" for x, y in (("0", "before"), ("", "after")) for c in ("auc", "mrr", "ndcg_5", "ndcg_10")),
    "slice_cold_warm": f"{_M}, {ctes('history')[5:]}, hl as (select imp, count(*) n from hist group by imp), sl as (select osp.imp, case when coalesce(n, 0) <= 5 then 'cold_start' else 'warm' end slice from osp left join hl using (imp) where split = 'test') select slice, {_MEANS}, count(*) < 30 small from sl left join pe using (imp) group by slice",
    "slice_head_tail": f"{_M}, {_HEAD}, fi as (select imp, arg_min(art, pos) art from sp where split = 'test' and label = 1 group by imp), sl as (select imp, case when hd.art is not null then 'head' else 'tail' end slice from fi left join hd using (art)) select slice, {_MEANS} from sl left join pe using (imp) group by slice",
    "novelty": f"{_TRAIN}, c as (select art, sum(label) c from sp where split = 'train' group by art having sum(label) > 0), n as (select sum(c) n from c) select imp, round(avg(-log2(coalesce(c / n, 1 / (n + 1)))), 6) novelty from sp left join c using (art), n where split = 'test' group by imp",
    "paired_predictions": f"{_FIRST} select label, count(*) n, cast(sum(cast(score > 0 as int)) as bigint) known from te group by label",
    "rank_submission": f"{_FIRST}, r as (select imp, pos, row_number() over (partition by imp order by score desc, pos) r from te) select imp impression_id, string_agg(cast(r as varchar), ',' order by pos) ranks from r group by imp",
    "submission_lines": f"{_FIRST}, r as (select imp, pos, row_number() over (partition by imp order by score desc, pos) r from te) select imp || ' [' || string_agg(cast(r as varchar), ',' order by pos) || ']' as value from r group by imp",
    "verify_submission": f"{_FIRST} select count(distinct imp) \"rows\", cast(0 as bigint) bad from te",
    "log_window": ctes("orders", "cut", "osplit") + ", b as (select min(t) lo, max(t) hi from osp where split = 'test') select imp, t, split = 'test' is_target from osp, b where t between lo - 86400000000 and hi",
}


def _lambda_sql(rows: str, truncation: int = 200) -> str:
    """gr: imp, row, label, g, h of rows (imp, row, label, score)."""
    return f"""lr as (select *, row_number() over (partition by imp order by score desc, row) k, row_number() over (partition by imp order by label desc, row) i from {rows}),
lm as (select *, sum(case when label > 0 then (pow(2, label) - 1) / log2(i + 1) else 0 end) over (partition by imp) m from lr),
lp as (select a.imp, a.row ra, b.row rb, abs(pow(2, a.label) - pow(2, b.label)) * abs(1 / log2(a.k + 1) - 1 / log2(b.k + 1)) / a.m gain, 1 / (1 + exp(a.score - b.score)) rho from lm a join lm b using (imp) where a.label > b.label and a.m > 0 and least(a.k, b.k) <= {truncation}),
ls as (select imp, row, sum(g) g, sum(h) h from (select imp, ra as row, rho * gain g, rho * (1 - rho) * gain h from lp union all select imp, rb, -rho * gain, rho * (1 - rho) * gain from lp) group by imp, row),
gr as (select r.*, coalesce(ls.g, 0) g, coalesce(ls.h, 0) h from {rows} r left join ls on r.imp = ls.imp and r.row = ls.row)"""


def _split_sql(name: str, placed: str, nodes: str) -> str:
    """The best split of each of the nodes of a relation (imp, row, node, g, h, b0, b1, ...)."""
    long = " union all ".join(f"select node, {i} f, b{i} bin, g, h from {placed} where node in ({nodes})" for i in range(len(_SPLIT_FEATURES)))
    sums = ", ".join(f"sum({x}) filter (bin > 0) over u {y}l, sum({x}) over o {y}t, coalesce(sum({x}) filter (bin = 0) over o, 0) {y}m" for x, y in (("g", "g"), ("h", "h"), ("n", "n")))
    side = ", ".join(f"coalesce({y}l, 0) + case when ml then {y}m else 0 end {y}l, {y}t" for y in "ghn")
    return f"""{name}c as (select node, f, bin, sum(g) g, sum(h) h, count(*) n from ({long}) group by node, f, bin),
{name}w as (select node, f, bin, {sums} from {name}c window o as (partition by node, f), u as (partition by node, f order by bin rows unbounded preceding)),
{name}d as (select node, f, bin, ml, {side} from {name}w, (values (false), (true)) t(ml) where bin > 0),
{name}g as (select node, f, bin, ml, nt, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht gain from {name}d where nl >= 50 and nt - nl >= 50 and hl >= 0.001 and ht - hl >= 0.001),
{name} as (select * from {name}g where gain > 1e-9 qualify row_number() over (partition by node order by round(gain, 9) desc, f, bin, ml) = 1)"""


def _place_sql(name: str, before: str, split: str, first: int) -> str:
    """Rows with those of the split node moved to nodes first and first + 1."""
    b = "case s.f " + " ".join(f"when {i} then b{i}" for i in range(len(_SPLIT_FEATURES))) + " end"
    return f"{name} as (select p.* exclude (node), case when s.node is null then p.node when {b} <= s.bin and ({b} > 0 or s.ml) then {first} else {first + 1} end node from {before} p left join {split} s on p.node = s.node)"


_BINS = ", ".join(f"case when {c} is null then 0 else cast(least(ceil({c}), {254}) as int) + 1 end b{i}" for i, c in enumerate(_SPLIT_FEATURES))
ORACLES["lambdamart_gradients"] = f"{_TRAIN}, tr as (select imp, pos as row, label, 1 / pos score from sp where split = 'train'), {_lambda_sql('tr')} select imp, row, round(g, 6) g, round(h, 6) h from gr"
ORACLES["lambdamart_first_tree"] = f"""{_TRAIN}, tr as (select imp, pos as row, label, 0.0 score, pos place, sum(label) over (partition by art) clicks, dwell from sp where split = 'train'), {_lambda_sql('tr')},
p0 as (select 0 node, imp, row, g, h, {_BINS} from gr), {_split_sql('s0', 'p0', '0')},
{_place_sql('p1', 'p0', 's0', 1)}, {_split_sql('s1', 'p1', '1, 2')}, t1 as (select * from s1 order by gain desc, node limit 1),
{_place_sql('p2', 'p1', 't1', 3)}, {_split_sql('s2', 'p2', '3, 4')}, t2 as (select * from (select * from s1 where node not in (select node from t1) union all select * from s2) order by gain desc, node limit 1)
select ['{"', '".join(_SPLIT_FEATURES)}'][f + 1] feature, bin, ml missing_left, round(gain, 4) gain, cast(nt as bigint) n from (select * from s0 union all select * from t1 union all select * from t2)"""
ORACLES["grouped_matrix"] = ctes("orders", "shown") + " select imp, count(*) n, true together, string_agg(cast(art as varchar), ' ' order by pos) arts from shown group by imp"
ORACLES["ranker_report"] = f"""{_M}, {_metrics('-pos', '0')}, re as (select count(distinct imp) filter (label > 0) / (select count(*) from osp where split = 'test') r from te),
both_ as (select 'before' stage, {_MEANS.replace("round(avg(coalesce(mrr, 0)), 6)", "avg(coalesce(mrr, 0))")} from osp left join pe0 using (imp) where split = 'test' union all select 'after', {_MEANS.replace("round(avg(coalesce(mrr, 0)), 6)", "avg(coalesce(mrr, 0))")} from osp left join pe using (imp) where split = 'test')
select stage, n_impressions, n_scored, auc, round(mrr, 6) mrr, ndcg_5, ndcg_10, round(r, 6) recall, round(case when stage = 'after' and r > 0 then mrr / r end, 6) captured from both_, re"""
_FM = f"""{_TRAIN}, {ctes('history', 'vectors')[5:]}, m as (select count(*) m from embeddings),
cd as (select imp, art, t, cast(min(pos) as bigint) rank, max(label) as label from shown group by imp, art, t),
g as (select sum(label) / count(*) g from sp where split = 'train'),
co as (select c.imp, c.art, count(s.imp) d, coalesce(sum(case when s.t < c.t - 600000000 then s.label else 0 end), 0) k from cd c left join shown s on c.art = s.art and s.t < c.t group by c.imp, c.art),
se as (select art, min(t) first_t from shown group by art),
cw as (select imp, p_brand c, sum(pow(0.9, n - i)) w from hist join part on art = p_partkey group by imp, p_brand), cs as (select imp, c, w / sum(w) over (partition by imp) s from cw),
hs as (select imp, count(*) n, avg(dwell) dw, sum(exp(-ln(2) / 168.0 * ((t - ct) / 3600000000.0))) e from hist group by imp),
cl as (select imp, sum(label) c from shown group by imp),
s0 as (select o.*, coalesce(c, 0) c, case when t - lag(t) over (partition by usr order by t, imp) > 1800000000 then 1 else 0 end nw from osp o left join cl using (imp)),
s1 as (select *, cast(usr as varchar) || '_' || cast(sum(nw) over (partition by usr order by t, imp rows unbounded preceding) as varchar) ss from s0),
s2 as (select imp, row_number() over w p, coalesce(sum(c) over (partition by split, ss order by t, imp rows between unbounded preceding and 1 preceding), 0) b from s1 window w as (partition by split, ss order by t, imp)),
uh as (select imp q, art, i k, n from hist), uw as (select q, art, k - greatest(n - 10, 0) i from uh where k > n - 10),
"""
from .retrieval import _KEYS, _PARTS, _UNIT, _WORDS  # noqa: E402

ORACLES["feature_matrix"] = _FM.rstrip() + f"""
{_WORDS}, {_PARTS.replace('te as', 'tm as')}, {_KEYS.replace('join te', 'join tm')},
bm as (select q imp, doc art, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)))) b from cd join po on art = doc join qt on q = imp and qt.term = po.term join tm on tm.term = po.term, st group by q, doc),
aq as (select distinct q imp from qt),
hv0 as (select imp q, art % m vec from hist, m), ds as (select q, unnest(e) x, generate_subscripts(e, 1) d from hv0 join vec using (vec)), dm as (select q, d, avg(x) x from ds group by q, d), {_UNIT},
cn as (select imp, art, list_dot_product(un.e, vec.e) c from cd join un on q = imp, m, vec where vec.vec = art % m)
select cd.imp, cd.art, coalesce(hs.n, 0) click_count, round(coalesce(hs.e, 0.0), 6) recency_weighted_engagement, cast(hs.n is not null as bigint) has_history_timestamps, round(hs.dw, 6) avg_history_dwell_time, cast(hs.dw is not null as bigint) has_dwell_time,
  extract(hour from make_timestamp(cd.t)) hour_of_day, isodow(make_timestamp(cd.t)) - 1 day_of_week, count(*) over (partition by cd.imp) impression_size, s2.p session_position, s2.p - 1 session_impressions_before, cast(s2.b as bigint) session_clicks_before,
  round(1 / ln(rank + 2), 6) position_bias, rank retrieval_rank, round(cast(cast(1 / rank as float) as double), 6) retrieval_score, cast(k as bigint) click_count_article, d display_count_article, round(ln(1 + k), 6) log_click_count_article, round((k + 50 * g) / (d + 50), 6) ctr_article,
  round(case when first_t < cd.t then ln(1 + (cd.t - first_t) / 3600000000.0) end, 6) freshness_log_hours, cast(first_t < cd.t as bigint) has_known_publish_time, cast(cs.s is not null as bigint) category_binary_match, round(coalesce(cs.s, 0.0), 6) category_affinity,
  round(case when aq.imp is not null then coalesce(bm.b, 0.0) end, 6) history_title_bm25, round(cn.c, 6) history_embedding_cosine, cd.label
from cd join co using (imp, art) join se on se.art = cd.art left join hs on hs.imp = cd.imp join s2 on s2.imp = cd.imp left join part on p_partkey = cd.art left join cs on cs.imp = cd.imp and cs.c = p_brand
left join bm on bm.imp = cd.imp and bm.art = cd.art left join aq on aq.imp = cd.imp left join cn on cn.imp = cd.imp and cn.art = cd.art, g
"""


# The bootstrap's multiplicities are hashes, so SQL draws the same ones.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def _weights(rows: str, draws: int, col: str = "x") -> str:
    """rep, the row's columns and w, of a relation with id."""
    u = f"(select rep, id, {col}, {draw_sql(config.SEED, 'rep', 'id')} / 4294967296.0 u from {rows}, range({draws}) reps(rep))"
    return f"(select *, {' + '.join(f'cast(u >= {c!r} as int)' for c in _POISSON)} w from {u})"


def _interval(rows: str) -> str:
    means = f"(select sum(w * x) / sum(w) m from {_weights(rows, config.BOOTSTRAP_DRAWS)} group by rep)"
    return f"(select count(*) from {rows}) n, round((select avg(x) from {rows}), 6) mean, round((select quantile_cont(m, 0.025) from {means}), 6) lo, round((select quantile_cont(m, 0.975) from {means}), 6) hi"


ORACLES["bootstrap_ci"] = _M + "".join(f", v_{c} as (select imp id, {c} x from pe where {c} is not null)" for c in ("auc", "mrr", "ndcg_10")) + " " + " union all ".join(f"select '{c}' metric, {_interval(f'v_{c}')}" for c in ("auc", "mrr", "ndcg_10"))
ORACLES["paired_bootstrap"] = f"""{_M}, {_metrics('-pos', '0')}, v as (select imp id, coalesce(pe.mrr, 0) - coalesce(pe0.mrr, 0) x from pe full join pe0 using (imp))
select {_interval('v')}, (select count(*) from v where x > 1e-12) wins, (select count(*) from v where abs(x) <= 1e-12) ties, (select count(*) from v where x < -1e-12) losses"""
ORACLES["coverage_ci"] = f"""{_FIRST}, ls as (select distinct imp id, 0 x from te), size as (select count(*) c from part),
co as (select rep, count(distinct art) / any_value(c) c from {_weights('ls', 200)} join te on id = imp, size where w > 0 group by rep), point as (select count(distinct art) / any_value(c) p from te, size)
select round(p, 8) coverage, round(quantile_cont(co.c, 0.025) + p - avg(co.c), 8) lo, round(quantile_cont(co.c, 0.975) + p - avg(co.c), 8) hi from co, point group by p"""
ORACLES["random_pair_diversity"] = ctes("vectors") + f""", n as (select count(*) n from vec), nu as (select row_number() over (order by vec) i, e from vec),
d as (select {draw_sql(config.SEED, 'k', '0')} % n + 1 i, {draw_sql(config.SEED, 'k', '1')} % n + 1 j from range(4000) t(k), n)
select count(*) pairs, round(1 - avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) diversity from d join nu a on d.i = a.i join nu b on d.j = b.i where d.i <> d.j"""
