"""Queries without SQL against plain Python, by value (those by sub-words, of sentences and of pairs have their own files)."""

import collections
import hashlib
import math
import os
import re
import zlib

import pytest

from gristmill.plans import registry
from gristmill.sources.inventory import PRIVATE
from tests.test_operators import bm25_plain

SF = "/root/testdata/sf0.001"
#: Held by value in tests/test_subword.py, test_sentences.py, test_pairs.py and (answers) test_operators.py.
ELSEWHERE = {"pair_scores", "rule_sentences", "subword_counts", "subword_sentence_counts", *(f"subword_{n}" for n in ("fixed_128", "fixed_254", "recursive_254", "sentence_254", "semantic_254"))}
HERE = {"chunk_recursive_254", "chunk_semantic", "chunk_sentences_packed", "hybrid_pool", "file_inventory", "schema_privacy"}
ONLY_RUN = {"compress_answer", "extractive_answer"}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}


def test_every_query_is_held():
    assert set(registry.QUERIES) - set(registry.ORACLES) == ELSEWHERE | HERE | ONLY_RUN


@pytest.mark.parametrize("name", sorted(ONLY_RUN))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def sentences(text):
    return [s.strip(" ") for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text) if s.strip(" ")]


def digests(name, docs, cut):
    rows = [(f"{name}::{d}::{i}", str(d), i, len(t.split()), hashlib.md5(t.strip().encode()).hexdigest()) for d, x in docs.items() for i, t in enumerate(cut(x)) if t.strip()]
    return sorted(rows)


def got(spark, name):
    return sorted((r.chunk_id, r.doc_id, r.chunk_index, r.token_count, r.text_md5) for r in registry.QUERIES[name](spark, SF).collect())


def pack(parts, size):
    """Parts one after the other, each looked at once with the chunk so far."""
    out = [[]]
    for p in parts:
        w = p.split()
        if len(w) > size:
            out += [w[i : i + size] for i in range(0, len(w), size)] + [[]]
        elif sum(len(x.split()) for x in out[-1]) + len(w) > size:
            out.append([p])
        else:
            out[-1].append(p)
    return [" ".join(x) for x in out if x]


def test_sentences_packed(spark, docs):
    assert got(spark, "chunk_sentences_packed") == digests("sentence_254", docs, lambda t: pack(sentences(t), 254))


def test_semantic(spark, docs):
    def vector(s):
        return collections.Counter(zlib.crc32(w.encode()) % 64 for w in s.lower().split())

    def alike(a, b):
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0

    def cut(text):
        out = []
        for s in sentences(text):
            n = len(s.split())
            if out and not (out[-1][1] + n > 254 or (out[-1][1] >= 127 and alike(vector(out[-1][2]), vector(s)) < 0.2)):
                out[-1] = [out[-1][0] + " " + s, out[-1][1] + n, s]
            else:
                out.append([s, n, s])
        return [x[0] for x in out]

    assert got(spark, "chunk_semantic") == digests("semantic_254", docs, cut)


def test_recursive(spark, docs):
    """No piece is too long, and all characters come in order, some twice."""
    by = collections.defaultdict(list)
    texts = {}
    from gristmill.operators import chunking
    from gristmill.plans.fragments import documents

    for r in chunking.build_chunks(documents(spark, SF), chunking.SPECS[2]).collect():
        texts[r.chunk_id] = r.text
        by[int(r.doc_id)].append((r.chunk_index, r.text.split(), r.token_count))
    assert got(spark, "chunk_recursive_254") == sorted((c, c.split("::")[1], int(c.split("::")[2]), len(t.split()), hashlib.md5(t.encode()).hexdigest()) for c, t in texts.items())
    for d, text in docs.items():
        whole, at = "".join(text.split()), 0
        for _, w, n in sorted(by[d]):
            own = "".join(w)
            assert 0 < len(w) == n <= 254
            start = next(i for i in range(at, -1, -1) if whole.startswith(own, i))  # separators start a piece, so words may be cut
            assert len(re.findall(r"\S+", text)) < 254 or at - start <= len("".join(w[:40]))  # an overlap of 38 words at most
            at = start + len(own)
        assert at == len(whole)


def test_hybrid_pool(spark, docs):
    chunks = {}
    for d, t in docs.items():
        w = t.split()
        for i, s in enumerate(range(0, max(1, len(w)), 109)):
            if w:
                chunks[f"fixed_128::{d}::{i}"] = " ".join(w[s : s + 128])
            if s + 128 >= len(w):
                break
    queries = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text is not None]

    def vector(text):
        v = collections.Counter(zlib.crc32(t.encode()) % 64 for t in re.findall(r"\w+", text.lower()))
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {k: x / norm for k, x in v.items()}

    lexical = bm25_plain(queries, list(chunks.items()), 20)
    vectors = {c: vector(t) for c, t in chunks.items()}
    want = {}
    for q, text in queries:
        own = vector(text)
        dense = [c for _, c in sorted((-round(sum(x * v.get(k, 0.0) for k, x in own.items()), 9), c) for c, v in vectors.items())[:20]]
        score, seen = collections.Counter(), {}
        for n, (ids, weight) in enumerate(((dense, 0.6), (lexical[q], 0.4))):
            for rank, c in enumerate(ids, 1):
                score[c] += weight / (60 + rank)
                seen.setdefault(c, (n, rank))
        want[q] = [(c, round(score[c], 9)) for c in sorted(score, key=lambda c: (-round(score[c], 9), seen[c]))[:20]]
    have = collections.defaultdict(list)
    for r in registry.QUERIES["hybrid_pool"](spark, SF).orderBy("query_id", "rank").collect():
        have[r.query_id].append((r.chunk_id, r.score))
    assert dict(have) == want


def test_inventory(spark):
    want = {(f, os.path.getsize(f"{SF}/{f}"), hashlib.sha256(open(f"{SF}/{f}", "rb").read()).hexdigest()) for f in os.listdir(SF) if f.endswith(".parquet")}
    assert {tuple(r) for r in registry.QUERIES["file_inventory"](spark, SF).collect()} == want


def test_privacy(spark):
    want = {(n, c) for n in ("documents", "benchmark", "conversations", "orders") for c in spark.read.parquet(f"{SF}/{n}.parquet").columns if c in PRIVATE}
    assert {tuple(r) for r in registry.QUERIES["schema_privacy"](spark, SF).collect()} == want
