"""Lists that stay one row: candidates of copies, and vectors held by each task against vectors joined."""

import random

from pyspark.sql import functions as F

from pressroom.models import nrms
from pressroom.operators import beyond, bm25, held, pool, semantic
from pressroom.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_copies_of_a_text_are_scored_once(spark, monkeypatch):
    """300 documents of 8 texts: the scores are those of all documents, and 8 are added up."""
    texts = ["a b", "a a c", "b c", "d", "a b c d", "b b", "c", ""]
    docs = spark.createDataFrame([(f"d{k:03}", texts[k % 8]) for k in range(300)], "doc string, text string")
    terms = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (3, "a", 1), (3, "b", 2), (4, "z", 1)], "q long, term string, qtf long")
    index = bm25.build(docs)
    want = sorted((r.q, r.doc, r["rank"], round(r.score, 8)) for r in bm25.top(bm25.score(index, terms), 60).collect())
    twins = {r.doc: r.same for r in bm25.twins(index, 20).collect()}
    assert sorted(twins) == [f"d{k:03}" for k in range(7)] and twins["d002"] == [f"d{k:03}" for k in range(2, 160, 8)]
    for most in (1 << 21, 3):
        monkeypatch.setattr(bm25, "BROADCAST_POSTINGS", most)
        lists, members = bm25.lists_of_distinct(index, terms, 60)
        assert lists.count() == 2 and members.count() == 4
        assert sorted((r.q, r.doc, r["rank"], round(r.score, 8)) for r in bm25.top_of_distinct(index, terms, 60).collect()) == want


def test_filling_happens_in_the_row(spark):
    lists = spark.createDataFrame([(1, [(7, 1, 2.0), (5, 2, 1.0)]), (2, None), (3, [(k, k, 1.0) for k in range(1, 5)])], "q long, list array<struct<art: long, rank: long, score: double>>")
    shown = spark.createDataFrame([(a, 1) for a in (9, 9, 9, 5, 5, 8)] + [(7, 0)], "art long, label int")
    out = pool.filled(lists, shown, 4)
    assert {r.q: [tuple(x) for x in r.list] for r in out.collect()} == {1: [(7, 1, 2.0), (5, 2, 1.0), (9, 3, 0.0), (8, 4, 0.0)], 2: [(9, 1, 0.0), (5, 2, 0.0), (8, 3, 0.0), (7, 4, 0.0)], 3: [(k, k, 1.0) for k in range(1, 5)]}


def test_held_vectors_are_pooled_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    v = A.vectors(spark, SF)
    h = spark.createDataFrame([(k, [rng.randrange(-3, 30) for _ in range(rng.randrange(0, 40))]) for k in range(90)], "q long, history array<long>")
    lists = h.select(F.col("q").alias("imp"), F.col("history").alias("vecs"))
    run = lambda: [sorted((r.q, [round(x, 9) for x in r.e]) for r in semantic.pooled(h, v, m, w).collect()) for m, w in (("mean", None), ("max", 7), ("decay", None))] + [sorted((r.imp, r.diversity and round(r.diversity, 9)) for r in beyond.diversity(lists, v).collect())]
    monkeypatch.setattr(held, "CHUNK", 50)
    few = run()
    for df in (semantic.pooled(h, v, "mean"), beyond.diversity(lists, v)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(held, "HELD_NUMBERS", 0)
    assert few == run()


def test_search_by_held_and_by_blocks_agree(spark, monkeypatch):
    """Ties by item, zero vectors, more blocks than one and users of several groups."""
    rng = random.Random(6)
    vec = lambda: [float(rng.randrange(-1, 2)) for _ in range(3)]
    v = spark.createDataFrame([(k, vec()) for k in range(70)], "vec long, e array<double>")
    u = spark.createDataFrame([(k, vec()) for k in range(40)] + [(40, [0.0] * 3)], "q long, e array<double>")
    items = {r.vec: r.e for r in v.collect()}
    want = {}
    for r in u.collect():
        s = sorted((-round(sum(a * b for a, b in zip(r.e, e, strict=True)), 9), k) for k, e in items.items())[:9]
        want[r.q] = [(k, i + 1, -x) for i, (x, k) in enumerate(s)] if any(r.e) else []
    one = lambda: {r.q: [tuple(x) for x in r.list] for r in semantic.cosine_lists(u, v, 9, block=16, together=8).collect()}
    assert one() == want
    monkeypatch.setattr(held, "HELD_NUMBERS", 0)
    assert one() == want


def test_neural_scores_move_numbers_of_vectors(spark, monkeypatch):
    """Articles of equal titles share a vector, which tasks hold; joined, vectors are never broadcast."""
    rng = random.Random(7)
    m = nrms.Weights.seeded(20)
    v = nrms.article_vectors(spark.createDataFrame([(c, [c % 4 + 1, 0, 0]) for c in range(1, 13)], "code long, tokens array<int>"), m)
    imps = spark.createDataFrame([(k, [0] * (k % 6) + [rng.randrange(1, 13) for _ in range(5 - k % 6)], [rng.randrange(1, 13) for _ in range(k % 4 + 1)]) for k in range(30)], "imp long, history array<int>, candidates array<int>")
    one = lambda: sorted((r.imp, r.pos, r.code, round(r.score, 9)) for r in nrms.scores(imps, v, m).collect())
    few = one()
    assert len(few) == sum(k % 4 + 1 for k in range(30)) and nrms._alike(v).select("rep").distinct().count() == 5
    monkeypatch.setattr(held, "HELD_NUMBERS", 0)
    joined = nrms.scores(imps, v, m)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert few == one()


def test_many_vectors_are_looked_up_in_files(spark, monkeypatch):
    """As held and as joined, without a shuffle of a vector by click; ids with gaps, negative ones, unknown ones, several files."""
    rng = random.Random(9)
    v = spark.createDataFrame([(k * 37 - 900, [rng.gauss(0, 1) for _ in range(5)]) for k in range(150)], "vec long, e array<double>")
    h = spark.createDataFrame([(k, [rng.choice([rng.randrange(150) * 37 - 900, 1, None]) for _ in range(rng.randrange(0, 30))]) for k in range(90)], "q long, history array<long>")
    lists = h.select(F.col("q").alias("imp"), F.col("history").alias("vecs"))
    run = lambda: [sorted((r.q, [round(x, 9) for x in r.e]) for r in semantic.pooled(h, v, m).collect()) for m in ("mean", "max", "decay")] + [sorted((r.imp, r.diversity and round(r.diversity, 9)) for r in beyond.diversity(lists, v).collect())]
    want = run()
    monkeypatch.setattr(held, "HELD_NUMBERS", 0)
    monkeypatch.setattr(held, "FILE_NUMBERS", 100)
    monkeypatch.setattr(held, "CHUNK", 64)
    for df in (semantic.pooled(h, v, "max"), beyond.diversity(lists, v)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert run() == want and len(held.filed(v).ends) > 5
    twice = v.unionByName(v.limit(1))
    assert held.filed(twice) is None and held.filed(v.where("vec is null")) is None
    monkeypatch.setattr(held, "_mounted", lambda spark: None)  # joined
    assert "Exchange" in beyond.diversity(lists, v)._jdf.queryExecution().executedPlan().toString()
    sums = lambda x: [[(q, sum(e) if isinstance(e, list) else e) for q, e in part] for part in x]
    for a, b in zip(sums(run()), sums(want), strict=True):
        assert [q for q, _ in a] == [q for q, _ in b] and all(x is y is None or abs(x - y) < 1e-6 for (_, x), (_, y) in zip(a, b, strict=True))


def test_cosines_of_a_list_are_made_in_its_row(spark, monkeypatch):
    """As scored by joins of pairs; users and items without a vector, zero vectors, empty lists."""
    rng = random.Random(10)
    v = spark.createDataFrame([(k, [0.0] * 4 if k == 3 else [rng.gauss(0, 1) for _ in range(4)]) for k in range(20)], "vec long, e array<double>")
    pick = lambda n: [rng.randrange(0, 25) for _ in range(n)]
    rows = [(k, pick(k % 4), pick(k % 6)) for k in range(60)] + [(60, [3], [3, 4]), (61, [24], [1])]
    lists = spark.createDataFrame(rows, "q long, history array<long>, wanted array<long>")
    users = semantic.pooled(lists, v, "mean")
    pairs = semantic.cosine_of(lists.select("q", F.explode(F.array_distinct("wanted")).alias("vec")), users, v)
    want = {(r.q, r.vec): r.score for r in pairs.collect()}
    same = lambda a, b: a is b is None or a is not None and b is not None and abs(a - b) < 1e-12

    def check():
        got = {r.q: r.scores for r in semantic.cosine_in_lists(lists, v).collect()}
        assert all(len(got[q]) == len(w) and all(same(want[q, x], y) for x, y in zip(w, got[q], strict=True)) for q, _, w in rows)

    check()
    assert "Exchange" not in semantic.cosine_in_lists(lists, v)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(held, "HELD_NUMBERS", 0)
    check()
    monkeypatch.setattr(held, "_mounted", lambda spark: None)  # joined
    check()


def test_a_pair_travels_without_weights(spark):
    """Weights of a query are joined after the document's terms, which are numbers."""
    docs = spark.createDataFrame([(k, "a b c" if k % 2 else "d e") for k in range(9)], "doc long, text string")
    terms = spark.createDataFrame([(1, "a", 1), (1, "zz", 2), (2, "e", 3)], "q long, term string, qtf long")
    pairs = spark.range(1, 4).selectExpr("id q").crossJoin(spark.range(10).selectExpr("id doc"))
    index = bm25.build(docs)
    want = {(r.q, r.doc): round(r.score, 8) for r in bm25.score(index, terms).collect()}
    got = {(r.q, r.doc): r.score for r in bm25.score_pairs(index, terms, pairs).collect()}
    assert len(got) == 30 and {k: round(s, 8) for k, s in got.items() if s} == want and got[2, 1] == 0.0 and got[3, 1] is None and got[1, 9] == 0.0
    assert dict(bm25.texts(index, bm25.coded(index)).dtypes)["_t"] == "array<struct<code:bigint,tf:int>>"


def test_a_pool_is_ranked_in_its_points_row(spark):
    """bm25_fresh: nothing is ranked by a window over points, and no exchange has both a point and an article."""
    import re

    from pressroom.operators import candidates
    from pressroom.plans import retrieval

    titles = A.catalogue(spark, SF)
    views = A.events(spark, SF).where("kind = 'view'").select(F.col("event_id").alias("q"), "usr", "t")
    h = spark.createDataFrame([(u, [1, 2, 3]) for u in range(20)], "q long, history array<long>")
    out = candidates.bm25_fresh(views, h, titles, A.displays(spark, SF), bm25.build(retrieval._part_docs(spark, SF)), 5, hours=6)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    q = re.search(r"event_id#\d+L? AS q#\d+L?", plan).group(0).split()[-1]
    assert not re.search(rf"Window \[.*windowspecdefinition\({re.escape(q)}", plan)
    lists = pool.lists_at(pool.segments(A.displays(spark, SF), 6), views.select("t").distinct()).select("t", F.inline("pool"))
    flat = pool.at_times(pool.segments(A.displays(spark, SF), 6), views.select("t").distinct())
    assert sorted(tuple(r) for r in lists.select(*flat.columns).collect()) == sorted(tuple(r) for r in flat.collect())


def test_the_cutoff_is_of_all_orders(spark):
    """Orders without lines count for the time span, as in SQL, and lines need not be joined to find it."""
    rows, log = spark.createDataFrame([(100,), (200,), (950,)], "t long"), spark.createDataFrame([(k,) for k in range(0, 1001, 100)], "t long")
    assert [r.split for r in A.split_of(rows, log).orderBy("t").collect()] == ["train", "train", "val"]


def test_novelty_reads_the_log_once(spark):
    from pressroom.plans import ranking

    assert "lineitem" not in ranking.novelty(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_joined_once(spark):
    """Neither arm is made again for the checks; other candidates and other labels are still errors."""
    import pytest
    from pressroom.operators import metrics
    from pressroom.plans import ranking

    assert "lineitem" not in ranking.paired_predictions(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    arm = lambda *rows: spark.createDataFrame(rows, "imp long, pos int, score double, label int")
    base, made = arm((1, 1, 0.5, 0), (1, 2, 0.25, 1)), spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: (made.add(1), x)[1], "double").asNondeterministic()
    got = metrics.paired(base.withColumn("score", counted("score")), arm((1, 1, 3.0, 0), (1, 2, 4.0, 1))).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0.5, 0, 3.0), (1, 2, 0.25, 1, 4.0)] and made.value == 2
    for other in (arm((1, 1, 3.0, 0)), arm((1, 1, 3.0, 0), (1, 2, 4.0, 1), (2, 1, 1.0, 0)), arm((1, 1, 3.0, 1), (1, 2, 4.0, 1))):
        with pytest.raises(ValueError):
            metrics.paired(base, other)


def test_semantic_lists_stay_in_their_users_row(spark, monkeypatch):
    """Whether vectors are held, in files or joined; users without history or vector, zero vectors. Only what is joined shuffles lists."""
    from pressroom.operators import candidates

    rng = random.Random(12)
    v = spark.createDataFrame([(k, [0.0] * 4 if k == 3 else [rng.gauss(0, 1) for _ in range(4)]) for k in range(150)], "vec long, e array<double>")
    h = spark.createDataFrame([(k, [rng.randrange(0, 160) for _ in range(1 + k % 5)]) for k in range(60)] + [(60, [3]), (61, [999, None])], "q long, history array<long>")
    d = spark.createDataFrame([(k % 30, k, int(k % 3 == 0)) for k in range(200)], "art long, t long, label int")
    q = spark.range(70).select(F.col("id").alias("q"))
    run = lambda w=None: candidates.semantic_(q, h, v, d, 9, window=w)
    rows = lambda df: sorted((r.q, r.rank, r.art, round(r.score, 8), r.used_fallback) for r in df.collect())
    want = rows(run()), rows(run(2))
    assert len(want[0]) == 9 * 70 and {r[0] for r in want[0] if r[4]} == {61, *range(62, 70)}
    plan = lambda: semantic.history_lists(q.join(h, "q", "left"), v, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan().index("MapInArrow") < plan().index("Join") and "Exchange" not in plan()[: plan().index("MapInArrow")]
    monkeypatch.setattr(held, "HELD_NUMBERS", 0)
    monkeypatch.setattr(held, "FILE_NUMBERS", 100)
    assert (rows(run()), rows(run(2))) == want and "Exchange" not in plan()[: plan().index("MapInArrow")]
    monkeypatch.setattr(held, "_mounted", lambda spark: None)
    assert (rows(run()), rows(run(2))) == want


def test_feature_matrix_reads_the_log_once(spark, monkeypatch):
    from pressroom.plans import ranking

    calls, shown = [], A.shown
    monkeypatch.setattr(A, "shown", lambda *a, **more: calls.append(1) or shown(*a, **more))
    ranking.feature_matrix(spark, SF)
    assert len(calls) == 1
