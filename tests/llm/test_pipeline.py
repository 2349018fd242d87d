from collections import Counter

from pressroom.llm import decontamination, mixing, near_dedup
from pressroom.llm import pipeline as corpus_pipeline
from pressroom.llm.toxicity import drop_toxic

from .helpers import SF, frame
from .test_relational import brute_components, duck


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    sets = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, SF))
        if k < 4:
            assert out.columns == cols
        sets.append((docs, out))
        docs = out
    (a, b), (_, c), (_, d), (_, e), (_, f) = sets
    assert b.subtract(drop_toxic(a, spark.read.parquet(f"{SF}/labels.parquet"))).count() == 0
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in a.collect()} - {r.doc_id for r in b.collect()}
    assert sum(labels.get(x, 1) == 0 for x in gone) <= 2
    rows = sorted(b.collect(), key=lambda r: r.doc_id)
    want, _ = brute_components([r.text for r in rows], 5, 80)
    assert {r.doc_id for r in c.collect()} == {rows[w].doc_id for w in set(want)}
    import pandas as pd

    bad = duck(decontamination.OP8_SQL, documents=c.toPandas()).df()
    assert {r.doc_id for r in d.collect()} == set(bad[~bad.contaminated].doc_id)
    mixed = duck(mixing.OP7_SQL, documents=d.toPandas()).df()
    assert Counter(r.doc_id for r in e.collect()) == Counter(mixed.doc_id)
    f = f.toPandas()
    assert len(f) == e.count() and f["shard"].value_counts().max() - f["shard"].value_counts().min() <= 1
    assert isinstance(f, pd.DataFrame)


def test_stages_on_odd_rows(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == frame(spark).columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert near_dedup.PERCENT == 80 and near_dedup.WORDS == 5
