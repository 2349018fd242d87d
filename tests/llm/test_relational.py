"""Sharding, mixing, decontamination, near duplicates, language-model scores: against brute force and DuckDB."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.llm import decontamination, lm_scoring, mixing, near_dedup, sharding

from .helpers import SF, docs, frame, words


def duck(sql, **tables):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'") if t not in tables else con.register(t, tables[t])
    return con.sql(sql)


def same(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    norm = lambda rows, names: sorted(tuple(repr(r[names.index(c)]) for c in cols) for r in rows)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(rel.fetchall(), rel.columns)


# sharding


def test_shards_are_even_and_gapless(spark):
    got = sharding.op3_sharding(spark, SF).toPandas()
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(d) and got.doc_id.is_unique
    assert got["shard"].value_counts().max() - got["shard"].value_counts().min() <= 1 and set(got["shard"]) == set(range(24))
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    for r in got.itertuples():
        raw = d.text[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)


def test_ring_walk_by_hand():
    """The aggregated walk against a walk of single keys: capacities hold, all are placed, keys at home where there is room."""
    load = np.random.default_rng(1).integers(0, 9, 1 << 10)
    at, who = sharding.ring(5, 16, 1 << 10)
    plan = sharding.assign(load, 5, 16)
    per = Counter()
    turns = {}
    for a, f, e, s in plan:
        per[s] += e - f
        turns.setdefault(a, []).append((f, e))
    assert sum(per.values()) == load.sum() and max(per.values()) - min(per.values()) <= 1
    for a, spans in turns.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == load[a] and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    loose = sharding.assign(load, 5, 16, slack=10.0)
    home = who[np.searchsorted(at, np.arange(len(load))) % len(at)]
    assert all(home[a] == s for a, _, _, s in loose)


def test_ring_walk_of_single_keys():
    """Key by key: every shard that a key passes on its way clockwise is full, and a key that was taken passed no room."""
    for seed, shards, slack in ((3, 5, 0.0), (4, 24, 0.0), (5, 7, 0.25)):
        load = np.random.default_rng(seed).integers(0, 30, 1 << 9)
        at, who = sharding.ring(shards, 16, len(load))
        plan = sharding.assign(load, shards, 16, slack)
        room = sharding.capacities(int(load.sum()), shards, slack)
        of = {(a, t): s for a, f, e, s in plan for t in range(f, e)}
        assert len(of) == load.sum()
        taken = Counter(of.values())
        full = {s for s in range(shards) if taken[s] == room[s]}
        assert all(taken[s] <= room[s] for s in range(shards))
        for (a, _), s in of.items():
            i = int(np.searchsorted(at, a)) % len(at)
            while who[i] != s:
                assert who[i] in full
                i = (i + 1) % len(at)


def test_sharding_hot_arc(spark, monkeypatch):
    """A third of all rows alike share an arc, which is numbered in lots: still one slot each, without gaps."""
    monkeypatch.setattr(sharding, "LOT", 10)
    d = spark.range(0, 600, 1, 4).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.col("id").alias("shard"))
    got = sharding.shard(d, 7).toPandas()
    assert len(got) == 600 and sorted(r["shard"] for r in got["row"]) == list(range(600))
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x))) and len(x) in (85, 86)


def test_growth_moves_little():
    load = np.random.default_rng(2).integers(50, 60, 1 << 16)
    own = lambda n: {(a, t): s for a, f, e, s in sharding.assign(load[:4096], n) for t in range(f, e)}
    a, b = own(24), own(25)
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.2  # by modulus 0.96 would move; 0.04 must


def test_sharding_odd_rows(spark):
    out = sharding.shard(frame(spark), 4).toPandas()
    assert len(out) == frame(spark).count() and sorted(out["shard"].value_counts()) in ([4, 4, 4, 5], [4, 4, 4, 4], [4, 4, 5, 4])
    assert sharding.shard(frame(spark, []), 4).count() == 0


# mixing


def test_mixing_sql_and_rates(spark):
    same(mixing.op7_mixing(spark, SF), duck(mixing.OP7_SQL))
    d = docs(spark, ["t"] * 4000, "a").unionByName(docs(spark, ["t"] * 1000, "b").withColumn("doc_id", F.col("doc_id") + 10_000))
    out = mixing.mix(d, {"a": 1.0, "b": 3.0})
    n = {r[0]: r[1] for r in out.groupBy("row.source").count().collect()}
    assert abs(n["a"] - 1250) < 150 and abs(n["b"] - 3750) < 250
    k = Counter(r["n"] for r in out.groupBy("row.doc_id").agg(F.count("*").alias("n"), F.first("row.source").alias("s")).where("s = 'b'").collect())
    import math

    assert all(abs(k[i] / 1000 - math.exp(-3.75) * 3.75**i / math.factorial(i)) < 0.05 for i in range(1, 8))


def test_mixing_odd_rows(spark):
    out = mixing.mix(frame(spark), temperature=0.5, total=60).collect()
    place = [r.place for r in out]
    assert place == sorted(place) and len({r["row"]["source"] for r in out}) == 2
    by = Counter((r["row"]["doc_id"], r.copies) for r in out)
    assert all(n % c == 0 for (_, c), n in by.items())
    assert mixing.mix(frame(spark, [])).count() == 0


# decontamination


def test_decontamination_sql(spark):
    same(decontamination.op8_decontamination(spark, SF), duck(decontamination.OP8_SQL))


def test_decontamination_planted(spark):
    """Items of all sizes, whole and in part, in documents of all sizes; items too short to be sure by MinHash, too."""
    rng = random.Random(9)
    items = [words(rng, n, 100_000) for n in (3, 5, 6, 7, 12, 14, 40, 200)]
    texts, want = [], []
    for size in (0, 30, 400, 8000):
        for k, it in enumerate(items):
            for part in (1.0, 0.9, 0.5):
                cut = it[: max(1, round(len(it) * part))]
                text = [*words(rng, size, 100_000), *cut, *words(rng, size, 100_000)]
                grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("=", *w)}
                texts.append(" ".join(text).upper() if rng.random() < 0.3 else " ".join(text))
                want.append([j for j, o in enumerate(items) if len(grams(o) & grams(text)) / len(grams(o)) >= 0.8])
    d = docs(spark, texts)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = decontamination.contained(d, bench)
    got = {r.doc_id: list(r["items"]) for r in decontamination.keyed(d).select("row.doc_id", "k1", "k2").join(found, ["k1", "k2"]).collect()}
    assert [got.get(k, []) for k in range(len(texts))] == want
    left = decontamination.decontaminate(d, bench)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {k for k, w in enumerate(want) if not w}


def test_decontamination_common_line(spark):
    """A line that all items begin with is in many documents: only those that hold an item are found, repeated texts alike."""
    rng = random.Random(10)
    line = words(rng, 14, 100_000)
    items = [line + words(rng, n, 100_000) for n in (6, 10, 20, 30, 60) for _ in range(4)]
    texts, want = [], []
    for k in range(60):
        own = [*words(rng, 200, 100_000), *line, *words(rng, 300, 100_000)]
        if k % 4 == 0:
            own += [w if rng.random() > 0.02 else "x" for w in items[k % len(items)]]
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        texts.append(" ".join(own))
        want.append([j for j, o in enumerate(items) if len(grams(o) & grams(own)) / len(grams(o)) >= 0.8])
    texts, want = texts + texts[:9], want + want[:9]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    d = docs(spark, texts)
    got = {r.doc_id: list(r["items"]) for r in decontamination.keyed(d).select("row.doc_id", "k1", "k2").join(decontamination.contained(d, bench), ["k1", "k2"]).collect()}
    assert [got.get(k, []) for k in range(len(texts))] == want and any(want) and not all(want)


def test_a_shared_line_makes_no_rows_of_pairs(spark, monkeypatch):
    """3,000 documents and 300 items with one line of 14 words in common, beside words of their own; one document holds an item."""
    rng = random.Random(8)
    line = " ".join(f"l{k}" for k in range(14))
    bench = [(k, " ".join([*words(rng, 20, 90_000), line, *words(rng, 12, 90_000)])) for k in range(300)]
    texts = [" ".join([*words(rng, 30, 90_000), line, *words(rng, 30, 90_000)]) for _ in range(2999)] + [" ".join(["so", bench[7][1], "it", "ends"])]
    made, met = [], decontamination._met

    def counted(*a):
        out = met(*a)
        made.append(out.count())
        return out

    monkeypatch.setattr(decontamination, "_met", counted)
    found = decontamination.contained(docs(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert [list(r["items"]) for r in found] == [[7]] and sum(made) < 100_000


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "two words")], "item_id long, text string")
    out = decontamination.decontaminate(frame(spark), bench)
    assert out.columns == frame(spark).columns
    assert {r.doc_id for r in frame(spark).collect()} - {r.doc_id for r in out.collect()} == {3}
    assert decontamination.decontaminate(frame(spark, []), bench).count() == 0
    assert decontamination.decontaminate(frame(spark), bench.where("item_id > 9")).count() == frame(spark).count()


# near duplicates


def brute_components(texts, n, percent):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = min(group[i], group[j]), max(group[i], group[j])
                group = [a if g == b else g for g in group]
    return group, [len(s) for s in sets]


def near_corpus(seed, groups=25):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = words(rng, rng.choice([2, 4, 12, 40, 150]), 3000)
        for _ in range(rng.choice([1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = w  # a chain: its ends needn't be linked
            out.append(" ".join(w))
    rng.shuffle(out)
    return [*out, None, "", out[0], out[0].upper()]


def test_near_duplicates_are_whole(spark):
    for seed, n, percent in ((1, 3, 85), (2, 5, 80)):
        texts = near_corpus(seed)
        want, sizes = brute_components(texts, n, percent)
        got = {r.d: (r.component, r.n) for r in near_dedup.near_duplicates(docs(spark, texts), n, percent).collect()}
        assert [got[k] for k in range(len(texts))] == list(zip(want, sizes, strict=True))
        assert len(set(want)) < len(want)


def test_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    texts = near_corpus(7, 6)
    want, _ = brute_components(texts, 3, 85)
    got = {r.d: r.component for r in near_dedup.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_pigeonhole_index_is_exact():
    """Any two signatures that differ in DISTANCE symbols share a key; and keys hold the symbols whole."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)] += 1
        assert np.intersect1d(near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)).size
    c = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
    assert not np.intersect1d(near_dedup.chunk_keys(a), near_dedup.chunk_keys(c)).size


def test_unlike_heads_lose_no_near_pair(spark, monkeypatch):
    """Every key that two near signatures share has a lesser node, unlike both: against all pairs, also in blocks of three."""
    rng = np.random.default_rng(11)
    width, chunks = near_dedup.WIDTH, near_dedup.CHUNKS
    sigs = {}
    for g in range(12):
        x = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
        for k in range(4):
            y = x.copy()
            y[rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE if k else 0, replace=False)] += k
            sigs[b"z%02d%d" % (g, k)] = y
        for c in range(chunks):
            head = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
            head[c * width : c * width + width] = x[c * width : c * width + width]
            sigs[b"a%02d%02d" % (g, c)] = head
    nodes = spark.createDataFrame([(bytearray(k), bytearray(v.tobytes())) for k, v in sigs.items()], "node binary, sig binary")
    for size in (3, 512):
        monkeypatch.setattr(near_dedup, "SIGNATURES", size)
        root = {bytes(r.node): bytes(r.root) for r in near_dedup.families(nodes).collect()}
        names = sorted(sigs)
        near = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (sigs[a] != sigs[b]).sum() <= near_dedup.DISTANCE]
        assert len(near) >= 36 and all(a in root and root[a] == root.get(b) for a, b in near)
        assert not any(k.startswith(b"a") for k in root)  # nothing is near to a head


def test_real_documents(spark):
    got = near_dedup.op9_near_dedup(spark, SF).toPandas().set_index("doc_id")
    d = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").toPandas()
    want, sizes = brute_components(list(d.text), 3, 85)
    assert [d.doc_id[w] for w in want] == list(got.component_id[d.doc_id]) and sizes == list(got.n_shingles[d.doc_id])
    assert list(got.kept[d.doc_id]) == [d.doc_id[w] == x for w, x in zip(want, d.doc_id, strict=True)]


def test_near_odd_rows(spark):
    d = frame(spark)
    out = near_dedup.drop_near_duplicates(d)
    assert out.columns == d.columns
    kept = Counter(r.doc_id for r in out.collect())
    assert kept[5] == 1  # of rows alike one stays
    assert 6 not in kept and {0, 1, 2, 3, 4, 8} <= set(kept)
    assert near_dedup.drop_near_duplicates(frame(spark, [])).count() == 0


def test_one_document_of_a_class_stays(spark):
    """Repeated ids with equal and with near-equal texts: one row a class, whichever columns clash."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base, "a"), (3, base, "b"), (3, base + " more", "c"), (4, base, "d"), (None, base, "e"), (5, "other text", "f"), (None, "", "g"), (None, "", "g")]
    out = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, `first` string")).collect()
    assert sorted(((r.doc_id or 0), len(r.text)) for r in out) in ([(0, 0), (0, 0), (3, len(base)), (5, 10)], [(0, 0), (0, 0), (3, len(base) + 5), (5, 10)])


def test_components_against_union_find(spark):
    """A hub of a third of all edges, chains, repeated edges and loops."""
    from pressroom.llm.components import components

    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    edges += edges[:9] + [(7, 7)]
    group = {x: x for e in edges for x in e}
    for _ in range(len(group)):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in group.items() if k in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# language model


def brute_lm(texts):
    import math

    toks = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").encode().decode().split(" ") if w] for t in texts]
    uni = Counter(w for t in toks for w in t)
    n = sum(uni.values())
    bi = Counter(b for t in toks for b in zip(t, t[1:], strict=False))
    out = []
    for t in toks:
        s = [math.log(uni[t[0]] / n)] if t else []
        for a, b in zip(t, t[1:], strict=False):
            s.append(math.log(bi[a, b] / uni[a]) if bi[a, b] >= lm_scoring.MIN_COUNT else math.log(lm_scoring.BACKOFF * uni[b] / n))
        out.append(sum(s) if t else None)
    return out


@pytest.mark.parametrize("block", [500_000, 50])  # many blocks, too
def test_lm_scores(spark, monkeypatch, block):
    """Whatever goes by broadcast and whatever by joins, rare first words included: the same scores."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(0, 80), 200)) for _ in range(80)] + [f"once{k} rare{k // 2} pair{k // 2} w1" for k in range(40)] + [None, "", "A b", "a B"]
    want = brute_lm(texts)
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    monkeypatch.setattr(lm_scoring, "REMEMBERED", block)
    for top, heavy, sample in ((1 << 20, 1 << 19, 1 << 15), (16, 40, 60), (0, 0, 1), (300, 0, 1)):
        got = {r.doc_id: r for r in lm_scoring.score(docs(spark, texts), top, heavy, sample).collect()}
        for k, w in enumerate(want):
            assert (w is None and got[k].total is None) or np.isclose(w, got[k].total)
            assert got[k].n_tokens == len((texts[k] or "").split())


def test_lm_sql_and_odd_rows(spark):
    same(lm_scoring.op10_lm_scoring(spark, SF), duck(lm_scoring.OP10_SQL))
    out = lm_scoring.score(frame(spark)).collect()
    assert len(out) == frame(spark).count() and sum(r.total is None for r in out) == 4
    assert lm_scoring.score(frame(spark, [])).count() == 0


def test_lm_repeated_rows(spark):
    """Rows alike count each and score alike; rows equal in doc_id alone are scored each by itself."""
    texts = ["a b c", "a b c", "a b d", "x"]
    d = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3])], "doc_id long, text string")
    want = brute_lm(texts)
    got = sorted((r.doc_id or 0, r.n_tokens, round(r.total, 9)) for r in lm_scoring.score(d).collect())
    assert got == sorted((k, len(t.split()), round(w, 9)) for k, t, w in zip((1, 1, 1, 0), texts, want, strict=True))


@pytest.mark.parametrize("rate", [0.01, 3.75, 745.0, 1000.0, 1e6])
def test_mixing_distribution(spark, rate):
    """The distribution function at every rate against the closed form, and the copies' mean and deviation."""
    import math

    r = mixing.poisson(spark.createDataFrame([("a", 5, rate), (None, 1, 0.0)], "s string, n long, rate double")).collect()
    none, one = sorted(r, key=lambda x: x.rate)
    assert none.least == 0 and none.cdf[0] == 1.0
    p = np.array([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(one.least, one.least + len(one.cdf))])
    assert np.allclose(one.cdf, np.cumsum(p), atol=1e-9 * max(1, rate**0.5)) and len(one.cdf) < 30 * rate**0.5 + 60
    u = np.random.default_rng(1).random(20_000)
    k = one.least + np.searchsorted(one.cdf, u, side="right")
    assert abs(k.mean() - rate) < 5 * (rate / len(u)) ** 0.5 + 1e-3 and abs(k.std() - rate**0.5) < 0.05 * rate**0.5


def test_mixing_by_either_join(spark, monkeypatch):
    """Distributions too large to send are joined by shuffle: the same rows."""
    d = spark.createDataFrame([(k, f"t{k}", "a" if k % 3 else "b") for k in range(300)], "doc_id long, text string, source string")
    few = lambda: sorted((r["row"].doc_id, r.copy, r.place) for r in mixing.mix(d).collect())
    want = few()
    monkeypatch.setattr(mixing, "CELLS", 3)
    assert few() == want


def test_mixing_large_rates(spark):
    """A rate beyond exp's range is drawn from its own distribution."""
    d = docs(spark, ["t"] * 40, "a").unionByName(docs(spark, ["t"] * 40, "b").withColumn("doc_id", F.col("doc_id") + 1000))
    n = {(r["row"]["source"], r["row"]["doc_id"]): r.copies for r in mixing.mix(d, {"a": 0.9, "b": 0.1}, total=40 * 1000, shuffled=False).where("copy = 1").select("row", "copies").collect()}
    a = [v for (s, _), v in n.items() if s == "a"]
    assert len(a) == 40 and len(set(a)) > 10 and all(abs(x - 900) < 6 * 30 for x in a) and abs(sum(a) / 40 - 900) < 6 * 30 / 40**0.5
