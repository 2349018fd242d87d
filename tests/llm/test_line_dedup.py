import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pressroom.llm.line_dedup import GRAM_WORDS, RUN_WORDS, _pack, cut_words, dedup_lines, op1_line_dedup, repeated_lines

from .helpers import SF, docs, frame, words


def brute(texts, need):
    """(doc, line) of lines in a run of `need` words or more that occurred before, line by line."""
    lines = [[(i, tuple(x.split())) for i, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    seen, out = {}, set()
    for d, own in enumerate(lines):
        for a in range(len(own)):
            run = ()
            for b in range(a, len(own)):
                run = (*run, own[b][1])
                if sum(map(len, run)) >= need:
                    first = seen.setdefault(run, (d, a))
                    if first < (d, a):
                        out |= {(d, own[x][0]) for x in range(a, b + 1)}
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(words(rng, rng.choice([1, 3, 8, 20, 60]))) for _ in range(60)]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(8)]
    texts = []
    for _ in range(30):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(runs) if rng.random() < 0.6 else [" ".join(words(rng, rng.randrange(1, 30)))]
            parts += [""] * rng.randrange(2)
        texts.append("\n".join(parts))
    return texts


def test_guarantee_and_no_more(spark):
    """All of runs of RUN_WORDS words go; nothing goes that isn't in a run of GRAM_WORDS."""
    for seed in (1, 2):
        texts = corpus(seed)
        got = {(r.d, i) for r in repeated_lines(docs(spark, texts)).collect() for i in r.gone}
        must, may = brute(texts, RUN_WORDS), brute(texts, GRAM_WORDS)
        assert must <= got <= may
        assert must


def test_text_and_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60))
    out = dedup_lines(docs(spark, [f"a\n{long}\nb", f"{long}\n\nc", long, "c"])).orderBy("row.doc_id").collect()
    assert [r["row"]["text"] for r in out] == [f"a\n{long}\nb", "\nc", "", "c"]
    got = dedup_lines(frame(spark))
    assert got.count() == frame(spark).count()
    same = [r for r in got.collect() if r["row"]["doc_id"] == 5]
    assert len(same) == 3 and len({r["row"]["text"] for r in same}) == 1  # rows alike are one document
    assert [r["row"]["text"] for r in got.collect() if r["row"]["doc_id"] == 6] == [""]
    assert dedup_lines(frame(spark, [])).count() == 0


def test_passages_inside_lines(spark):
    """All words of later copies of RUN_WORDS words go and no others, wherever lines begin and end."""
    rng = random.Random(9)
    passages = [words(rng, n, 10**6) for n in (49, 50, 51, 80, 200)]
    texts = []
    for k in range(30):
        w = [x for _ in range(3) for x in (*words(rng, rng.randrange(1, 30), 10**6), *rng.choice(passages))]
        texts.append("".join(x + rng.choice([" ", " ", "  ", "\n", "\t"]) for x in w))
    seen, want = set(), []
    for t in texts:
        w, off = t.split(), set()
        for i in range(len(w) - RUN_WORDS + 1):
            run = tuple(w[i : i + RUN_WORDS])
            if run in seen:
                off |= set(range(i, i + RUN_WORDS))
            seen.add(run)
        want.append([x for i, x in enumerate(w) if i not in off])
    got = dedup_lines(docs(spark, texts)).orderBy("row.doc_id").collect()
    assert [r["row"]["text"].split() for r in got] == want
    assert sum(map(len, want)) < sum(len(t.split()) for t in texts) / 2


def test_query_by_brute_force(spark):
    """The query's columns, from runs found by comparing all windows of whole texts in the order of documents."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    seen, want = set(), {}
    for d, text in rows:
        w, cut = (text or "").encode().split(), []
        for i in range(len(w) - RUN_WORDS + 1):
            run = tuple(w[i : i + RUN_WORDS])
            if run in seen:
                cut += [i, i + RUN_WORDS]
            seen.add(run)
        left, gone = cut_words(text, cut) if cut else (text or "", [])
        want[d] = ((text or "").count("\n") + 1, gone, len(gone), len(left), zlib.crc32(left.encode()))
    got = {r.doc_id: (r.n_lines, list(r.gone), r.n_gone, r.chars_left, r.text_crc32) for r in op1_line_dedup(spark, SF).collect()}
    assert got == want and sum(len(x[1]) for x in want.values()) > 20


def test_a_shared_passage_is_sent_once_a_task():
    """2,000 documents with one passage of 80 words: no partition gets more than thrice the median of windows, though cuts are whole."""
    rng = random.Random(6)
    passage = words(rng, 80, 10**6)
    texts = [" ".join([*words(rng, 60, 10**6), *passage, *words(rng, 60, 10**6)]) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array(texts)], ["d", "t", "x"])
    sent, cut = Counter(), 0
    for out in _pack(16, GRAM_WORDS, RUN_WORDS)(iter([batch])):
        for p, body in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            n, m = np.frombuffer(body, "<i8", 2)
            if n < 0:
                cut += m
            else:
                sent[p] += int(m)
    assert cut == 1999 and len(sent) == 16 and max(sent.values()) <= 3 * sorted(sent.values())[8]
