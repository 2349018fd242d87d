"""Readers and sinks on files written here."""

import datetime as dt
import os
import random
import shutil
import subprocess
import zipfile
import zlib

import pytest

from pressroom.operators import codec
from pressroom.sources import archive, readers, sinks


@pytest.fixture
def mind(tmp_path):
    for p in ("train", "dev"):
        (tmp_path / p).mkdir()
    news = 'N1\tnews\tworld\t"Quote left open\tabs\thttp://x\t[{"Label": "A"}, {"No": 1}]\tnot json\nN2\tsport\tball\tNA\t\tu\t[]\t[{"Label": "B"}]\n'
    (tmp_path / "train/news.tsv").write_text(news)
    (tmp_path / "dev/news.tsv").write_text("N2\tother\tball\tLater\t\tu\t[]\t[]\nN3\tsport\tball\tThird\tx\tu\t[]\t[]\n")
    (tmp_path / "train/behaviors.tsv").write_text("1\tU1\t11/9/2019 1:02:03 PM\tN1  N2\tN1-0 N-2-1\n2\tU2\t11/10/2019 12:00:00 AM\t\tN2-1\n")
    (tmp_path / "dev/behaviors.tsv").write_text("1\tU1\t11/15/2019 1:02:03 AM\tN1\tN3 N1-1\n")
    return tmp_path


def test_mind(spark, mind):
    articles, behaviors = readers.mind(spark, str(mind / "train"), str(mind / "dev"))
    got = {r.article_id: r for r in articles.collect()}
    assert set(got) == {"N1", "N2", "N3"} and got["N2"].category == "sport" and got["N2"].title == "NA" and got["N2"].abstract == ""
    assert got["N1"].title == '"Quote left open' and got["N1"].entities == ["A"] and got["N2"].entities == ["B"] and got["N1"].published_time is None
    b = {(r.raw_split, r.impression_id): r for r in behaviors.collect()}
    one = b["train", "1"]
    assert one.time == dt.datetime(2019, 11, 9, 13, 2, 3) and one.history == ["N1", "N2"] and one.candidates == ["N1", "N-2"] and one.labels == [0, 1]
    assert b["train", "2"].history == []
    test = readers.mind_test_behaviors(spark, str(mind / "dev/behaviors.tsv")).first()
    assert test.candidates == ["N3", "N1"]
    assert {r.article_id: r.text for r in readers.mind_catalogue(spark, str(mind / "dev/news.tsv")).collect()} == {"N2": "Later", "N3": "Third x"}


def test_ebnerd(spark, tmp_path):
    t = dt.datetime(2023, 5, 1, 10)
    spark.createDataFrame([(7, "T", None, None, "news", ["a"], t, None)], "article_id int, title string, subtitle string, body string, category_str string, subcategory array<string>, published_time timestamp, ner_clusters array<string>").write.parquet(str(tmp_path / "articles.parquet"))
    for p in ("train", "validation"):
        spark.createDataFrame([(1, 5, t, 9, [7, 8], [8, 99], 3.0, 4.0), (2, 6, t, 9, [7], [], 1.0, 1.0)], "impression_id int, user_id int, impression_time timestamp, session_id int, article_ids_inview array<int>, article_ids_clicked array<int>, read_time double, next_read_time double").write.parquet(str(tmp_path / p / "behaviors.parquet"))
        spark.createDataFrame([(5, [7], [1.5], [t])], "user_id int, article_id_fixed array<int>, read_time_fixed array<double>, impression_time_fixed array<timestamp>").write.parquet(str(tmp_path / p / "history.parquet"))
    articles, behaviors = readers.ebnerd(spark, str(tmp_path))
    a = articles.first()
    assert (a.article_id, a.abstract, a.category, a.entities) == ("7", "", "news", [])
    b = {(r.raw_split, r.impression_id): r for r in behaviors.collect()}
    assert b["train", "1"].labels == [0, 1] and b["train", "1"].history == ["7"] and b["dev", "2"].history == [] and b["dev", "2"].labels == [0]
    assert not {"read_time", "next_read_time"} & set(behaviors.columns)  # what would leak isn't read
    assert readers.ebnerd_catalogue(spark, str(tmp_path / "articles.parquet")).first().text == "T"
    log = behaviors.withColumnRenamed("raw_split", "split")
    assert readers.load_log(log, "dev").where("is_target").count() == 2


def test_embeddings(spark, tmp_path):
    spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "article_id int, v array<float>").write.parquet(str(tmp_path / "e.parquet"))
    got = {r.article_id: list(r.embedding) for r in readers.provided_embeddings(spark, str(tmp_path / "e.parquet"), spark.createDataFrame([("1",), ("2",), ("9",)], "article_id string")).collect()}
    assert got == {"1": [0.6, 0.8], "2": [0.0, 0.0]}


def test_submission_file(spark, tmp_path):
    ranked = spark.createDataFrame([(2, [1, 2]), (1, [2, 3, 1]), (10, [])], "impression_id long, ranks array<int>")
    path = sinks.write_submission(ranked, str(tmp_path), "mind")
    sinks.verify_archive(spark, path, "mind", 3)
    assert zipfile.ZipFile(path).read("prediction.txt").decode() == "1 [2,3,1]\n2 [1,2]\n10 []\n"
    with pytest.raises(ValueError):
        sinks.verify_archive(spark, path, "mind", 4)
    with pytest.raises(ValueError):
        sinks.verify_archive(spark, path, "ebnerd", 3)
    assert sinks.bad_ranks(ranked).count() == 0
    assert sinks.bad_ranks(spark.createDataFrame([(1, [1, 1]), (2, [0, 1]), (3, [2, 1])], "impression_id long, ranks array<int>")).count() == 2


def test_archive_of_many_parts_resumes(spark, tmp_path):
    """Deflated by many tasks, stopped and taken up again: a whole zip, whose ranking was computed once and whose records are read by many tasks."""
    rng = random.Random(3)
    rows = [(i * 7, rng.sample(range(1, 40), 39)) for i in range(9000)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    ranked = spark.createDataFrame(rows, "impression_id long, ranks array<int>").repartition(6)
    ranked = ranked.mapInArrow(counted, "impression_id long, ranks array<int>")
    assert sinks.write_submission(ranked, str(tmp_path), "ebnerd", parts=9, group=2, stop_after=4) == ""
    first = sorted((tmp_path / "deflated").rglob("*.parquet"))
    path = sinks.write_submission(ranked, str(tmp_path), "ebnerd", parts=9, group=2)
    assert seen.value == 9000 and set(first) < set((tmp_path / "deflated").rglob("*.parquet"))
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["predictions.txt"]
        text = z.read("predictions.txt").decode()
    assert text == "".join(f"{i} [{','.join(map(str, r))}]\n" for i, r in rows)
    sinks.verify_archive(spark, path, "ebnerd", 9000)
    got = sinks.archive_lines(spark, path, "ebnerd").orderBy("line").collect()
    assert [r.line for r in got] == list(range(9000)) and "".join(f"{r.value}\n" for r in got) == text
    if shutil.which("unzip"):
        assert subprocess.run(["unzip", "-tq", path], capture_output=True).returncode == 0
    size = os.path.getsize(path)
    assert size % archive.RECORD == 0 and size > 3 * archive.RECORD
    with open(path, "r+b") as f:  # a changed byte is found
        f.seek(size // 3)
        b = f.read(1)
        f.seek(size // 3)
        f.write(bytes([b[0] ^ 1]))
    with pytest.raises(Exception):  # noqa: B017  by zlib or by the lines' form
        sinks.verify_archive(spark, path, "ebnerd", 9000)


def test_checksums_combine():
    rng = random.Random(1)
    for n, m in ((0, 0), (1, 0), (0, 5), (3, 4), (1000, 77_777), (5, 1 << 20)):
        a, b = rng.randbytes(n), rng.randbytes(m)
        assert archive.crc_combine(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, [1.0]), ("val", 2, None)], "split string, x int, v array<double>")
    sinks.write_table(df, str(tmp_path / "t"), "split")
    assert spark.read.parquet(str(tmp_path / "t")).where("split = 'val'").first().x == 2
    sinks.report(df, str(tmp_path / "r"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "r.json")).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert {(r.split, r.x, r.v) for r in spark.read.option("header", "true").csv(str(tmp_path / "r.csv")).collect()} == {("train", "1", "[1.0]"), ("val", "2", None)}
    many = spark.range(12_345)
    sinks.report(many, str(tmp_path / "many"))
    assert spark.read.json(str(tmp_path / "many.json")).count() == 12_345  # nothing is cut off


def test_codec_round_trip(spark):
    ids = spark.createDataFrame([(f"N{k}",) for k in range(300)] + [("",), (None,), ("N5",)], "art string")
    c = codec.codec(ids)
    got = {r.art: r.code for r in c.collect()}
    assert [got[a] for a in sorted(got)] == list(range(1, 301))
    e = codec.encode(spark.createDataFrame([("N5",), ("?",)], "art string"), c)
    assert {r.art: r.code for r in e.collect()} == {"N5": got["N5"], "?": 0}
    assert {r.code: r.art for r in codec.decode(e.select("code"), c).collect()} == {got["N5"]: "N5", 0: None}


def test_partitions_grow_with_the_log(spark, monkeypatch):
    """A shuffle begins with more partitions for a longer log, and never with fewer than the session has."""
    from pressroom.sources import adapters

    first, most = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    try:
        adapters.table(spark, "/root/testdata/sf0.001", "lineitem")
        assert spark.conf.get(first, None) is None and spark.conf.get(most, None) is None
        monkeypatch.setattr(adapters, "LOG_ROWS", 100)
        adapters.table(spark, "/root/testdata/sf0.001", "lineitem")
        n = int(spark.conf.get(first))
        assert n == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 100 and spark.conf.get(most) == "16m"
        adapters.table(spark, "/root/testdata/sf0.001", "events")
        assert int(spark.conf.get(first)) == n
    finally:
        spark.conf.unset(first)
        spark.conf.unset(most)
