"""Guarantees on hand-built rows."""

import math

import pytest
from pyspark.sql import functions as F

from pressroom.operators import beyond, bm25, impressions, metrics, pool, sampling, sessions, stats
from pressroom.operators.split import split_behaviors

H, M = 3_600_000_000, 60_000_000


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_split_is_by_time_span(spark):
    train = rows(spark, [(h * H,) for h in (50, 0, 100, 95, 10)], "t long")
    dev = rows(spark, [(h * H,) for h in (120, 130)], "t long")
    got = {r.t // H: r.split for r in split_behaviors(train, dev, 0.1).collect()}
    assert got == {0: "train", 10: "train", 50: "train", 95: "val", 100: "val", 120: "test", 130: "test"}
    with pytest.raises(ValueError):
        split_behaviors(dev, train, 0.1)


def test_asof_ties_lag_and_buckets(spark):
    d = rows(spark, [("a", 0, 1), ("a", 0, 0), ("a", 100 * M, 1), ("b", 100 * M, 0)], "art string, t long, label int")
    p = rows(spark, [("a", 0), ("a", 100 * M), ("a", 105 * M), ("a", 110 * M), ("a", 111 * M), ("b", 100 * M), ("c", 1)], "art string, t long")
    want = {("a", 0): (0, 0), ("a", 100 * M): (2, 1), ("a", 105 * M): (3, 1), ("a", 110 * M): (3, 1), ("a", 111 * M): (3, 2), ("b", 100 * M): (0, 0), ("c", 1): (0, 0)}
    for bucket in (stats.BUCKET, 7 * M, M):
        got = {(r.art, r.t): (r.display_count, r.click_count) for r in stats.asof_counts(d, p, 10 * M, bucket).collect()}
        assert got == want


def test_smoothing_uses_the_training_prior(spark):
    counts = rows(spark, [("a", 10, 5)], "art string, display_count long, click_count long")
    got = stats.smoothed(counts, stats.global_ctr(rows(spark, [(1,), (0,)], "label int"))).first()
    assert got.ctr == (5 + 50 * 0.5) / 60 and got.log_clicks == math.log(6)
    assert stats.global_ctr(rows(spark, [], "label int")).first().g == 0


def _pool(spark, events, times, hours=1):
    segs = pool.segments(rows(spark, events, "art string, t long, click int"), hours, 24, 10)
    return pool.at_times(segs, rows(spark, [(t,) for t in times], "t long"))


def test_pool_ties_age_and_lag(spark):
    assert _pool(spark, [("a", 100 * M, 0), ("b", 100 * M, 0)], [100 * M]).count() == 0
    got = {r.art: r.shown for r in _pool(spark, [("old", 0, 0), ("new", 100 * M, 0)], [100 * M + 1]).collect()}
    assert got == {"old": 0, "new": 1}
    got = {r.art: (r.shown, r.clicked) for r in _pool(spark, [("a", 100 * M, 1), ("b", 105 * M, 1)], [112 * M]).collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}
    # the window is closed on the left and open on the right
    got = {r.t: (r.shown, r.shown_back) for r in _pool(spark, [("a", 0, 0)], [0, 1, H, H + 1, 24 * H, 24 * H + 1]).collect()}
    assert got == {1: (1, 1), H: (1, 1), H + 1: (0, 1), 24 * H: (0, 1)}


def test_pool_ranking_and_backfill(spark):
    ev = [("a", 100 * M, 0), ("b", 100 * M, 1), ("b", 101 * M, 1), ("a", 102 * M, 1), ("c", 103 * M, 0), ("o1", 0, 0), ("o2", 0, 0), ("o2", 1, 0)]
    got = pool.ranked(_pool(spark, ev, [120 * M]), 4).orderBy("rank").collect()
    assert [(r.art, r.score, r.backfill) for r in got] == [("b", 2.0, False), ("a", 1.0, False), ("c", 0.0, False), ("o2", 0.0, True)]
    assert [r.art for r in pool.ranked(_pool(spark, ev, [120 * M]), 1).collect()] == ["b"]


def test_padding_is_distinct_and_flagged(spark):
    found = rows(spark, [("u", "x", 1, 2.0)], "q string, art string, rank long, score double")
    shown = rows(spark, [("x", 1), ("x", 1), ("y", 1), ("z", 0)], "art string, label int")
    got = pool.padded(found, rows(spark, [("u",), ("v",)], "q string"), shown, 3).orderBy("q", "rank").collect()
    assert [(r.q, r.art, r.score, r.used_fallback) for r in got] == [("u", "x", 2.0, False), ("u", "y", 0.0, False), ("u", "z", 0.0, False), ("v", "x", 0.0, True), ("v", "y", 0.0, True), ("v", "z", 0.0, True)]
    w = pool.wide(pool.padded(found, rows(spark, [("u",)], "q string"), shown, 3))
    assert [tuple(r) for r in pool.long(w).orderBy("rank").collect()] == [("u", "x", 1, 2.0), ("u", "y", 2, 0.0), ("u", "z", 3, 0.0)]


def test_sessions(spark):
    df = rows(spark, [(1, 0, 1, 1), (1, 5 * M, 2, 2), (1, 35 * M, 3, 3), (1, 65 * M + 1, 4, 0), (2, 0, 5, 0)], "usr long, t long, imp long, clicks int")
    got = {r.imp: (r.session, r.session_position, r.impressions_before, r.clicks_before) for r in sessions.session_context(sessions.sessions(df)).collect()}
    assert got == {1: ("1_s0", 1, 0, 0), 2: ("1_s0", 2, 1, 1), 3: ("1_s0", 3, 2, 3), 4: ("1_s1", 1, 0, 0), 5: ("2_s0", 1, 0, 0)}


def test_engagement_and_dwell(spark):
    df = rows(spark, [(24 * H, [12 * H, 18 * H], 2), (24 * H, None, 3), (24 * H, [], 0)], "t long, times array<long>, n int")
    score, timed = impressions.engagement(F.col("n"), F.col("times"), F.col("t"), halflife=12)
    got = df.select(score.alias("s"), timed.alias("k")).collect()
    assert math.isclose(got[0].s, 0.5 + 2**-0.5) and got[0].k
    assert math.isclose(got[1].s, 1 + 0.9 + 0.81) and not got[1].k
    assert got[2].s == 0 and not got[2].k
    d = rows(spark, [([1.0, None, float("nan"), 3.0],), ([None],), ([],)], "v array<double>").select(impressions.mean_dwell(F.col("v")).alias("m")).collect()
    assert [r.m for r in d] == [2.0, None, None]


def test_category_affinity(spark):
    h = rows(spark, [(1, [("a",), ("b",), ("c",)])], "imp long, history array<struct<art:string>>")
    cat = rows(spark, [("a", "news"), ("c", "sport"), ("x", "sport"), ("y", "food"), ("z", "")], "art string, category string")
    w = {r.category: r.weight for r in impressions.category_weights(h, cat).collect()}
    assert math.isclose(w["news"], 0.81) and w["sport"] == 1.0  # the unknown article keeps its place
    got = {r.art: (r.category_binary_match, round(r.category_affinity, 6)) for r in impressions.affinity(rows(spark, [(1, a) for a in "xyz"], "imp long, art string"), impressions.category_weights(h, cat), cat).collect()}
    assert got == {"x": (1, round(1 / 1.81, 6)), "y": (0, 0.0), "z": (0, 0.0)}


def test_queries_and_bm25(spark):
    titles = rows(spark, [("a", "big red ball"), ("b", "red car")], "art string, title string")
    h = rows(spark, [(1, ["a", "?", "b"])], "q long, history array<string>")
    terms = lambda m, w=None, i=None: {r.term: r.qtf for r in bm25.query_terms(h, titles, m, w, i, 2).collect()}
    assert terms("direct") == {"big": 1, "red": 2, "ball": 1, "car": 1}
    assert terms("direct", 1) == {"red": 1, "car": 1}
    assert terms("recency_weighted") == {"big": 1, "red": 4, "ball": 1, "car": 3}  # the unknown one is the second
    index = bm25.build(rows(spark, [(1, "red ball"), (2, "blue ball"), (3, "Red RED sun")], "doc long, text string"))
    assert terms("tfidf_keywords", None, index) == {"red": 1, "ball": 1}
    q = rows(spark, [(1, "red", 1), (1, "nothing", 5)], "q long, term string, qtf long")
    got = {r.doc: r.score for r in bm25.score(index, q).collect()}
    idf, avg = math.log((3 - 2 + 0.5) / 2.5 + 1), 7 / 3
    assert got == {1: round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg)), 9), 3: round(idf * 5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)), 9)}
    assert [r.score for r in bm25.subset(bm25.score(index, q), rows(spark, [(1, 2), (1, 99)], "q long, doc long")).collect()] == [0.0, 0.0]


def test_metrics_ties_and_degenerate_groups(spark):
    s = rows(spark, [(1, 1, 0.5, 1), (1, 2, 0.5, 0), (2, 1, 0.1, 0), (2, 2, 0.9, 0), (3, 1, 1.0, 1)], "imp long, pos int, score double, label int")
    got = {r.imp: r for r in metrics.per_impression(s).collect()}
    assert got[1].auc == 0.5 and got[1].mrr == 0.5 and math.isclose(got[1].ndcg_5, 1 / math.log2(3))  # the later position first
    assert got[2].auc is None and got[2].mrr == 0 and got[2].ndcg_10 == 0
    assert got[3].auc is None and got[3].mrr == 1 and got[3].ndcg_5 == 1
    p = metrics.population(metrics.per_impression(s), rows(spark, [(k,) for k in (1, 2, 3, 4)], "imp long")).first()
    assert p.n_impressions == 4 and p.n_scored == 3 and p.auc == 0.5 and p.mrr == 1.5 / 4
    r = {x.impression_id: x.ranks for x in metrics.submission(rows(spark, [(1, 1, 0.2), (1, 2, 0.1), (1, 3, 0.3), (2, 1, 0.0), (2, 2, 0.0)], "imp long, pos int, score double")).collect()}
    assert r == {1: [2, 3, 1], 2: [1, 2]}


def test_recalls_differ(spark):
    found = rows(spark, [(1, ["a", "b"]), (2, ["c"]), (4, ["a"])], "imp long, candidates array<string>")
    clicked = rows(spark, [(1, ["a", "z"]), (2, ["x"]), (3, ["a"]), (4, [])], "imp long, clicked array<string>")
    assert metrics.recall(found, clicked).first().recall == 0.25
    assert metrics.hit_rate(found, clicked, 2, rows(spark, [(k,) for k in (1, 2, 3, 4)], "imp long")).first().hit_rate == 0.25


def test_paired_population_is_checked(spark):
    a = rows(spark, [(1, 1, 0.5, 1)], "imp long, pos int, score double, label int")
    assert metrics.paired(a, a).count() == 1
    with pytest.raises(ValueError):
        metrics.paired(a, a.withColumn("label", F.lit(0)))
    with pytest.raises(ValueError):
        metrics.paired(a, a.withColumn("pos", F.lit(2)))


def test_sampling(spark):
    c = rows(spark, [(i, k, k, int(k < 2)) for i in range(3) for k in range(60)], "imp long, art long, rank int, label int")
    got = sampling.negatives(c, 4, 10).collect()
    for i in range(3):
        own = [r for r in got if r.imp == i]
        assert sum(r.label for r in own) == 2 and len(own) == 16 and {2, 3, 4, 5} <= {r.art for r in own}
    assert sorted(map(tuple, got)) == sorted(map(tuple, sampling.negatives(c.repartition(7), 4, 10).collect()))
    s = rows(spark, [(1, 1, "a", 1), (1, 2, "b", 0), (1, 3, "c", 1), (2, 1, "d", 1)], "imp long, pos int, art string, label int")
    for r in (out := sampling.wu(s).collect()):
        assert len(r.candidates) == 5 and r.candidates[r.label] == {1: "a", 3: "c"}[r.pos] and set(r.candidates) <= {"a", "b", "c"}
    assert len(out) == 2  # an impression without negatives is left out


def test_beyond_accuracy(spark):
    v = rows(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec long, e array<double>")
    got = {r.imp: r.diversity for r in beyond.diversity(rows(spark, [(1, [1, 2]), (2, [1, 3]), (3, [1]), (4, [9])], "imp long, vecs array<long>"), v).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None, 4: None}
    p = stats.click_probabilities(rows(spark, [("a", 3), ("b", 1), ("c", 0)], "art string, click_count long"))
    n = {r.imp: r.novelty for r in beyond.novelty(rows(spark, [(1, ["b"]), (2, ["c"]), (3, [])], "imp long, arts array<string>"), p, F.lit(1 / 5)).collect()}
    assert n[1] == 2.0 and math.isclose(n[2], math.log2(5)) and n[3] == 0
    assert beyond.coverage(rows(spark, [(1, ["a", "b"]), (2, ["b", "c"])], "imp long, arts array<string>"), 10).first().coverage == 0.3


def test_bootstrap(spark):
    v = rows(spark, [(k, float(k % 10)) for k in range(400)] + [(1000, None)], "id long, x double")
    r = beyond.bootstrap(v, draws=200).first()
    assert r.n == 400 and r["mean"] == 4.5 and 4.0 < r.lo < 4.5 < r.hi < 5.0
    p = beyond.paired_bootstrap(v.na.fill(0.0), v.na.fill(0.0).withColumn("x", F.col("x") + 1), draws=100).first()
    assert p.wins == 401 and p.losses == 0 and abs(p["mean"] - 1) < 1e-9 and abs(p.lo - 1) < 1e-9
    lists = rows(spark, [(k, [(k * 7 + j) % 500 for j in range(3)]) for k in range(300)], "imp long, arts array<long>")
    c = beyond.coverage_bootstrap(lists, 500, draws=40).first()
    assert c.lo <= c.coverage <= c.hi
