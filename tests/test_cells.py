"""Common pools over chunkers."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions.tokens import from_file
from gristmill.operators import cells, retrieval, subword
from gristmill.plans import chunks as plans
from tests.test_operators import bm25_plain

SF = "/root/testdata/sf0.001"


def corpus(spark, seed, n, words, rare=0):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(r.choices(voc, weights, k=r.randint(1, 25)) + [f"rare{r.randrange(40)}"] * (r.random() < rare)) for _ in range(n)]
    return [(f"c{i:04d}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,n,words,k", [(1, 400, 60, 5), (3, 30, 5, 20), (4, 8, 30, 20)])
def test_lists_are_exact(spark, seed, n, words, k):
    """Also where weights are negative, lists are longer than the corpus, and terms repeat or are unknown."""
    chunks = corpus(spark, seed, n, words, 0.5)
    r = random.Random(seed)
    queries = [(i, " ".join(r.choices(t.split(), k=r.randint(1, 9)))) for i, (_, t) in enumerate(r.sample(chunks, min(8, n)))] + [(90, "unknown"), (91, ""), (92, "w0 w0 w1")]
    c, q = spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3), spark.createDataFrame(queries, "query_id int, text string")
    got = collections.defaultdict(list)
    for row in retrieval.bm25(q, c, k).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.chunk_id)
    assert dict(got) == bm25_plain(queries, chunks, k)


def test_keys_are_as_lists_of_their_own(spark):
    parts = {"x": corpus(spark, 1, 60, 20), "y": corpus(spark, 2, 9, 20), "z": corpus(spark, 3, 200, 40, 0.3)}
    rows = [(k, c, t) for k, v in parts.items() for c, t in v]
    q = spark.createDataFrame([(1, "w0 w5 w9"), (2, "w1 w2"), (3, "nothing"), (4, "rare3 w0")], "query_id int, text string")
    all_ = spark.createDataFrame(rows, "chunker string, chunk_id string, text string").repartition(4)
    found = cells.lists(q, all_, 12)
    for side, alone in ((found[0], lambda c: retrieval.dense(cells.hashed(q, "query_id"), cells.hashed(c, "chunk_id"), 12)), (found[1], lambda c: retrieval.bm25(q, c, 12))):
        got = {tuple(r) for r in side.collect()}
        want = {(k, *tuple(r)) for k, v in parts.items() for r in alone(spark.createDataFrame(v, "chunk_id string, text string")).collect()}
        assert got == want


def test_dense_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    vectors = [(f"v{i:03d}", "ab"[i % 2], [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(300)]
    queries = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(6)]) for i in range(23)]
    v = spark.createDataFrame(vectors, "chunk_id string, chunker string, vector array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, vector array<double>")
    want = {}
    for i, x in queries:
        for key in "ab":
            best = sorted((-round(sum(a * b for a, b in zip(x, y)), 9), c) for c, k, y in vectors if k == key)[:7]
            want |= {(key, i, n + 1): c for n, (_, c) in enumerate(best)}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 16)
    for most in (1000, 3):  # query blocks broadcast, and dealt out
        monkeypatch.setattr(retrieval, "SMALL", most)
        got = {(r.chunker, r.query_id, r.rank): r.chunk_id for r in retrieval.dense(q, v, 7, ("chunker",)).collect()}
        assert got == want
    assert retrieval.dense(q.limit(0), v, 3).count() == 0 and retrieval.dense(q, v.limit(0), 3).count() == 0


def test_cells_of_the_frozen_chunkers(spark, tmp_path):
    """Four chunkers by sub-words; each cell's lists are those of its chunks alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").cache()
    tok = from_file(__import__("public_tokenizers").path(plans.VOCABULARY))
    chunks = subword.build_all(docs, tok).cache()
    q = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 6").selectExpr("item_id as query_id", "text", "text as span")
    relevant = spark.createDataFrame([(0, "1"), (1, "2")], "query_id long, doc_id string")
    found = cells.lists(q, chunks)
    pools = cells.candidates(found, q, chunks, relevant).cache()
    c = cells.cells(found, pools).cache()
    names = [s["name"] for s in subword.SPECS]
    expected = q.select("query_id").crossJoin(spark.createDataFrame([(n,) for n in names], "chunker string"))
    assert c.count() == 6 * 4 and cells.incomplete(c, expected).count() == 0
    own = chunks.where(F.col("chunker") == "recursive_254")
    lone = {(r.query_id, r.rank): r.chunk_id for r in retrieval.bm25(q, own, cells.DEPTH).collect()}
    got = {(r.query_id, x.rank): x.chunk_id for r in c.where("chunker = 'recursive_254'").collect() for x in r.bm25_candidates}
    assert got == lone
    grades = {(r.query_id, r.chunk_id): r.grade for r in pools.collect()}
    assert all(g == 1 for (i, chunk), g in grades.items() if g != 2 and chunk.split("::")[1] == {0: "1", 1: "2"}.get(i))
    told = cells.write(pools, c, f"file://{tmp_path}/cells", names)
    assert told["candidates"] == 480 and told["cells"] == 24 and told["smallest_pool"] == 20
    assert [r["chunker"] for r in told["runtime"]] == names and all(r["candidates"] == 120 and 0 <= r["seconds"] <= told["seconds"] + 1 for r in told["runtime"])
    again = spark.read.parquet(f"file://{tmp_path}/cells/candidates")
    assert again.count() == 480
    assert cells.write(pools.repartition(3), c, f"file://{tmp_path}/again", names)["digest"] == told["digest"]
    assert cells.incomplete(c.where("query_id <> 2"), expected).count() == 4
