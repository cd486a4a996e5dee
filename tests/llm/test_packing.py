"""Packing against the tokenizer's own ids, laid one after the other."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm import packing

PATH = P.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def expected(own, text):
    return own.encode(text or "", add_special_tokens=False).ids + [0]


def check(got, rows, own, length):
    """Pieces tell of each document its whole ids, and of each sequence but the last `length` of them."""
    texts, pieces, filled = defaultdict(list), defaultdict(list), defaultdict(list)
    for d, t in rows:
        texts[d].append(expected(own, t))
    for r in got:
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for d, ids in texts.items():
        if len(ids) > 1:  # repeated ids: as many pieces as all of them have
            assert sum(r.length for r in pieces[d]) == sum(map(len, ids))
            continue
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[0]) and r.length >= 1
            assert bytes(r.ids) == np.array(ids[0][at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids[0])
    total = sum(len(x) for v in texts.values() for x in v)
    assert sorted(filled) == list(range(-(-total // length)))
    for s, rs in filled.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == (length if s < len(filled) - 1 else total - length * s)


@pytest.mark.parametrize("length", [1, 64, 1024])
def test_pieces(docs, rows, own, length):
    check(packing.pack(docs, length).collect(), rows, own, length)


def test_repeated_rows_and_nothing(docs, rows, nothing, own):
    again = docs.unionByName(docs.where("doc_id in (3, 9, 20)"))
    check(packing.pack(again, 16).collect(), [*rows, *((d, t) for d, t in rows if d in (3, 9, 20))], own, 16)
    assert packing.pack(nothing).count() == 0 and packing.sequences(packing.pack(nothing)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, 0)


def test_long_text(spark, own):
    rows = [(1, "lorem ipsum, dolor " * 60_000), (2, "x" * 50_000), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(packing.pack(docs, 1024).collect(), rows, own, 1024)


def test_sequences_are_the_ids_in_order(docs, own):
    pieces = packing.pack(docs, 32)
    sequences = packing.sequences(pieces, 32).collect()
    by_place = {(r.sequence_id, r.offset): list(np.frombuffer(bytes(r.ids), "<u4")) for r in pieces.collect()}
    for s in sequences:
        assert len(s.ids) + s.padding == 32 and [x.offset for x in s.documents] == sorted(x.offset for x in s.documents)
        assert s.ids == [i for x in s.documents for i in by_place[s.sequence_id, x.offset]]
    assert sum(s.padding > 0 for s in sequences) <= 1


def test_query(spark, own):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: expected(own, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = packing.query(spark, sf).collect()
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(docs[r.doc_id])
    assert sum(r.length for r in got) == sum(map(len, docs.values()))


def test_offsets_over_many_tasks(spark):
    totals = [(p, p * 7 % 13) for p in range(0, 5000, 3)]
    got = {r.part: r.ahead for r in packing.offsets(spark.createDataFrame(totals, "part int, tokens long")).collect()}
    ahead = 0
    for p, n in totals:
        assert got[p] == ahead
        ahead += n


texts = st.text(st.one_of(st.sampled_from(" \t\n'a1é²ß½,.\x1c\x85\xa0 日ñ🙂s"), st.characters(exclude_categories=("Cs",))), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), texts), min_size=1, max_size=6))
def test_ids_of_any_text(batch):
    ours, tok = packing.encoder(PATH), packing.encoder(PATH).tokenizer
    ids, sizes = ours.encode(pa.array(batch, pa.string()))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [expected(tok, t) for t in batch]


def test_without_the_quick_way(own):
    slow = packing.Encoder(PATH)
    slow.quick = None
    batch = ["a b  c", None, "naïve café", " x"]
    ids, sizes = slow.encode(pa.array(batch, pa.string()))
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [expected(own, t) for t in batch]
