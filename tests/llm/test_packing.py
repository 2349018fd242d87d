"""Packing: ids by the tokenizer on whole texts, exact round trip, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pressroom.llm import packing

from .helpers import SF, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def encoded(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


def padded(lengths):
    """Tokens of padding of sequences, by the contract: to 4096, but for powers of two."""
    return sum(0 if n & (n - 1) == 0 else 4096 - n for n in lengths)


def check(rows, documents):
    """rows: pieces with ids; documents: (doc_id, text)."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    want = defaultdict(list)
    for d, text in documents:
        want[d].append(encoded(text))
    assert set(pieces) == set(want)
    for d, own in pieces.items():
        if len(want[d]) > 1:  # documents of one id: their pieces together
            assert sorted(x for r in own for x in np.frombuffer(r.ids, "<u4")) == sorted(x for w in want[d] for x in w)
            continue
        ids = []
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == len(ids) and r.doc_tokens == len(want[d][0])
            ids += np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[d][0]
    return [sum(r.length for r in s) for s in sequences.values()]


def test_round_trip_on_odd_rows(spark):
    df = frame(spark)
    lengths = check(packing.pack(df, PATH).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert padded(lengths) <= 0.02 * sum(lengths)
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = check(packing.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padded(lengths) <= 0.01 * sum(lengths)
    got = packing.op11_packing(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.agg({"length": "sum"}).first()[0] == sum(lengths)


def test_groups_of_remainders(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 5000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(9)
    lengths = check(packing.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padded(lengths) <= 0.02 * sum(lengths)


WORDS = packing.WordIds(PATH, 200)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB éÉ×ßµªİΣς'sdt漢1٣ \t\n\x0b\x1c\x7f\x85\xa0 ́ﬁ<|endoftx>-_!😀‍"), max_size=60))
def test_parts_are_the_text(text):
    assert WORDS.of(pa.array([text]), 2)[0].tolist() == encoded(text)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBreéÉÀþß'sdtmLVl19 \t\n\x0b\x00\x1c\x1f\x7f-_!<>"), max_size=40), max_size=3))
def test_plain_parts_are_the_texts(texts):
    assert [x.tolist() for x in WORDS.of(pa.array(texts, pa.string()), 2)] == [encoded(x) for x in texts]


def test_every_plain_character_and_special_tokens():
    plain = [chr(c) for c in range(256) if packing._PLAIN.fullmatch(chr(c))]
    texts = [a + b + "x" for a in plain for b in ("'", "s", "É", "1", "-", " ", "")]
    texts += ["a <|endoftext|> b", "it<|endoftext|>'s", "<|startoftext|><|endoftext|>", "x" * 5000, "don't  you'LL", "", " "]
    assert [x.tolist() for x in WORDS.of(pa.array(texts, pa.string()), 2)] == [encoded(x) for x in texts]


@pytest.mark.parametrize("capacity", [16, 100, 4096])
def test_cuts(capacity):
    rng = random.Random(1)
    for n in rng.sample(range(1, capacity + 1), min(capacity, 500)):
        own = packing.cuts(n, capacity)
        assert sum(own) == n and len(own) <= 8
        for x in own:
            k = capacity // x
            assert k * x <= capacity and capacity // k - x <= packing.SLACK * x


def test_bins_hold_a_fixed_count():
    rng = random.Random(2)
    bins = packing.Bins(4096)
    for d in range(3000):
        for p in packing.pieces(d, np.zeros(rng.randrange(1, 9000), dtype=np.int32), 4096, packing.SLACK):
            if own := bins.put(p):
                assert {4096 // len(q.ids) for q in own} == {len(own)} and sum(len(q.ids) for q in own) <= 4096
    left = bins.rest()
    assert sum(len(p.ids) for p in left) < 128 * 4096
    closed = list(packing.close(left, 4096))
    assert [sum(len(p.ids) for p in s) for s in closed[:-20]] == [4096] * len(closed[:-20])
    assert all((n := sum(len(p.ids) for p in s)) & (n - 1) == 0 for s in closed)
    assert sum(len(p.ids) for s in closed for p in s) == sum(len(p.ids) for p in left)
