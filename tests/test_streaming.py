import random

import pytest
from pyspark.sql import functions as F

from pressroom.streaming import jobs, pool

M = 60_000_000


SHOWN = "event_id long, art long, t long, click int"


def brute_windows(rows, hours=1, back=24, lag=10):
    """Counts of rows (event_id, art, t, click) among all of them."""
    out = {}
    for e, a, t, _ in rows:
        own = [(u, c) for _, b, u, c in rows if b == a and u < t]
        out[e] = (sum(u >= t - 60 * hours * M for u, _ in own), sum(u >= t - 60 * back * M for u, _ in own), sum(c for u, c in own if t - 60 * hours * M <= u < t - lag * M), False)
    return out


def _windows(spark, tmp_path, chunks, delay="0 seconds", each_run=True):
    """Runs the stream over chunks of rows; returns what came out of each run, and rows of state after each."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    got, state = [], []
    for rows in chunks:
        spark.createDataFrame(rows, SHOWN).coalesce(1).write.mode("append").parquet(src)
        jobs.run_append(pool.windows(jobs.files(spark, src, SHOWN), delay=delay), out, str(tmp_path / "mark"))
        got.append({r.event_id: (r.shown, r.shown_back, r.clicked, r.late) for r in spark.read.schema(pool.OUT).parquet(out).collect()})
        state.append(sum(spark.read.format("statestore").option("path", str(tmp_path / "mark")).option("stateVarName", v).load().count() for v in ("waiting", "seen")))
    return got, state


def test_windows_over_chunks_and_late_rows(spark, tmp_path):
    first = [(1, 7, 0, 1), (2, 7, 0, 0), (3, 7, 11 * M, 0)]
    late = (4, 7, 5 * M, 1)
    got, _ = _windows(spark, tmp_path, [first, [late, (5, 7, 61 * M, 0)]])
    want = brute_windows([*first, (5, 7, 61 * M, 0)])
    assert got[1] == want | {4: (None, None, None, True)}
    jobs.run_append(pool.windows(jobs.files(spark, str(tmp_path / "in"), SHOWN)), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5  # nothing new: nothing again


def test_rows_out_of_order_within_the_delay(spark, tmp_path):
    """Chunks overlap in time by less than the delay: each row comes out once, with all rows before it, and only when none can come before it."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), rng.randrange(600) * M // 2, rng.randrange(2)) for i in range(120)]
    rows.sort(key=lambda r: r[2] + rng.randrange(30) * M)
    chunks = [rows[k : k + 30] for k in range(0, 120, 30)] + [[(999, 50, 2_000 * M, 0)]]
    got, _ = _windows(spark, tmp_path, chunks, "30 minutes")
    seen = -1
    for rs, g in zip(chunks, got, strict=True):
        seen = max(seen, *(r[2] for r in rs))
        assert set(g) == {e for e, _, t, _ in rows if t // 1000 <= seen // 1000 - 30 * 60_000}
    assert got[-1] == {e: w for e, w in brute_windows(rows).items()}


def test_state_of_idle_articles_goes(spark, tmp_path):
    day = 24 * 60 * M
    many = [(i, i, i * 1000, 0) for i in range(40)]
    got, state = _windows(spark, tmp_path, [many, [(100, 1, day // 2, 0)], [(101, 999, 3 * day, 0)]])
    assert len(got[-1]) == 42 and state[0] == 40 and state[1] == 41 and state[2] == 1


def test_sessions_close_once(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "event_id long, usr long, t long"
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    got = []
    chunks = [[(1, 1, 0), (2, 1, 20 * M), (3, 2, 5 * M)], [(4, 1, 50 * M), (2, 1, 20 * M), (5, 2, 36 * M)], [], [(6, 3, 200 * M), (7, 1, 10 * M)], [(8, 3, 300 * M)]]
    for rows in chunks:
        if rows:
            spark.createDataFrame([(e, u, t + M) for e, u, t in rows], schema).coalesce(1).write.mode("append").parquet(src)
        jobs.run_append(jobs.closed_sessions(jobs.files(spark, src, schema), delay="10 minutes"), out, mark)  # each run is a restart
        got.append(sorted((r.usr, r.n, r.first_t - M, r.last_t - M) for r in spark.read.schema("usr long, n long, first_t long, last_t long").parquet(out).collect()))
    # Event 2 comes twice and counts once; 50 is 30 minutes after 20, in the same session; 7 is behind the watermark.
    first = [(1, 3, 0, 50 * M), (2, 1, 5 * M, 5 * M), (2, 1, 36 * M, 36 * M)]
    assert got == [[], [(2, 1, 5 * M, 5 * M)], [(2, 1, 5 * M, 5 * M)], first, sorted([*first, (3, 1, 200 * M, 200 * M)])]


def _scoring(spark):
    log = spark.createDataFrame([(1, 10, 0), (1, 10, 1), (1, 20, 1), (2, 15, 1), (4, 1, 0)], "art long, t long, label int")
    catalogue = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "art long, category string")
    priors = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "category string, ctr double")
    return jobs.versions(log), catalogue, priors


def test_lookups_are_as_of(spark):
    stats, catalogue, priors = _scoring(spark)
    chunk = spark.createDataFrame([(1, 10, [1, 2, 3, 4, 9]), (2, 11, [1, 1]), (3, 20, [1, 2]), (4, 99, [1]), (5, 5, []), (6, 5, None)], "impression_id long, t long, candidates array<long>")
    got = {r.impression_id: r.scores for r in jobs.lookup_scores(chunk, stats, catalogue, priors, 0.1, 50.0).collect()}
    s = lambda k, n, c: (k + 50 * c) / (n + 50)
    want = {1: [s(0, 0, 0.5), s(0, 0, 0.25), s(0, 0, 0.5), s(0, 1, 0.1), s(0, 0, 0.1)], 2: [s(1, 2, 0.5)] * 2, 3: [s(1, 2, 0.5), s(1, 1, 0.25)], 4: [s(2, 3, 0.5)], 5: [], 6: []}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_scored_chunks_resume(spark, tmp_path):
    """A run that dies in a chunk does that chunk again, and the whole equals one batch."""
    stats, catalogue, priors = _scoring(spark)
    schema, src, out, mark = "impression_id long, t long, candidates array<long>", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = [(i, i % 30, [1 + i % 4, 2, 3]) for i in range(12)]
    for k in range(0, 12, 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(src)
    done = []

    def score(chunk):
        return jobs.ranked(jobs.lookup_scores(chunk, stats, catalogue, priors, 0.1))

    def dies(chunk):
        done.append(1)
        if len(done) == 3:
            raise RuntimeError("lost")
        return score(chunk)

    with pytest.raises(Exception, match="lost"):
        jobs.run_chunks(jobs.files(spark, src, schema), dies, out, mark)
    before = spark.read.schema("value string").parquet(f"{out}/*").count()
    assert before == 6
    jobs.run_chunks(jobs.files(spark, src, schema), score, out, mark)
    got = sorted(r.value for r in spark.read.schema("value string").parquet(f"{out}/*").collect())
    assert got == sorted(r.value for r in score(spark.createDataFrame(rows, schema)).collect()) and len(got) == 12


def test_ranked_sink_resumes(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "impression_id long, scores array<double>"
    run = lambda: jobs.run_append(jobs.ranked(jobs.files(spark, src, schema)), str(tmp_path / "out"), str(tmp_path / "mark"), "text")
    spark.createDataFrame([(1, [0.2, 0.1, 0.3])], schema).coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(2, [0.0, 0.0]), (3, [])], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 [2,3,1]", "2 [1,2]", "3 []"]


def test_first_seen_is_a_running_minimum(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "art long, t long"
    run = lambda: jobs.run_table(jobs.first_seen(jobs.files(spark, src, schema)), str(tmp_path / "out"), str(tmp_path / "mark"))
    spark.createDataFrame([(1, 50), (2, 10)], schema).coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(1, 5), (2, 70)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {r.art: r.first_t for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 5, 2: 10}


def test_a_log_that_goes_back_is_refused(spark):
    ok = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "place long, t long")
    pool.check_sorted(ok)
    with pytest.raises(ValueError):
        pool.check_sorted(ok.unionByName(spark.createDataFrame([(4, 1)], "place long, t long")))
    long = spark.range(1000).select(F.col("id").alias("place"), F.col("id").alias("t"))
    pool.check_sorted(long)
    pool.check_sorted(long.limit(0))
    for at in (1, 15, 16, 17, 500, 999):  # inside ranges and between them
        with pytest.raises(ValueError):
            pool.check_sorted(long.withColumn("t", F.when(F.col("place") == at, at - 2).otherwise(F.col("t"))))


def test_chunks_shuffle_no_statistics(spark, monkeypatch):
    """Statistics of a scored stream lie bucketed by article: no chunk's plan exchanges them, and their table goes."""
    import re

    from pressroom.plans import streams
    from pressroom.streaming import jobs

    plans, score = [], jobs.lookup_scores

    def seen(*args):
        out = score(*args)
        out.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the stream's own session
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(jobs, "lookup_scores", seen)
    before = {t.name for t in spark.catalog.listTables()}
    assert streams.stream_scored(spark, "/root/testdata/sf0.001").count() > 0
    assert plans and {t.name for t in spark.catalog.listTables()} == before
    for plan in plans:  # nothing between the statistics' scan and their join shuffles
        scan = re.search(r"FileScan parquet [^\n]*\[art#\d+L?,b#\d+L?[^\n]*", plan)
        assert scan and "Bucketed: true" in scan.group(0), plan
        above = plan[: scan.start()].splitlines()[-3:-1]
        assert "Sort" in above[0] and "Filter" in above[1], plan
