"""Model plug-ins with deterministic stand-ins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import retrieval, scoring


def overlap_model():
    return lambda pairs: [len(set(q.split()) & set(t.split())) for q, t in pairs]


def test_pair_scorer_in_rerank(spark):
    q = spark.createDataFrame([(1, "red fox")], "query_id int, text string")
    c = spark.createDataFrame([("a", "blue"), ("b", "red fox runs"), ("c", "fox")], "chunk_id string, text string")
    pool = retrieval.bm25(q, c, 3)
    score = scoring.pair_scorer(overlap_model, batch=2)(F.col("query_text"), F.col("text"))
    got = retrieval.rerank(pool, q, c, 2, score).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("b", 2.0), ("c", 1.0)]
    rows = scoring.serialise(pool.withColumn("doc_id", F.lit("d")), ["query_id"]).first().candidates
    assert [x["rank"] for x in rows] == [1, 2, 3]


def test_margin():
    logits = np.arange(24, dtype=float).reshape(2, 3, 4)
    got = scoring.final_margin(logits, np.array([[1, 1, 0], [1, 1, 1]]), 3, 1)
    assert got.tolist() == [2.0, 2.0]
    with pytest.raises(ValueError):
        scoring.final_margin(logits, np.array([[0, 0, 0], [1, 1, 1]]), 3, 1)


def test_probability(spark):
    r = spark.createDataFrame([(0.0,), (2.0,)], "m double").select(scoring.probability(F.col("m")).alias("p")).collect()
    assert math.isclose(r[0].p, 0.5) and math.isclose(r[1].p, math.exp(2) / (math.exp(2) + 1))


def test_generate(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "x")], "id int, p string")
    out = scoring.generate(df, "p", lambda: lambda ps: [x.upper() for x in ps], cap=3)
    assert [(r.raw_output, r.generated_tokens, r.generation_length_capped) for r in out.orderBy("id").collect()] == [("A B C", 3, True), ("X", 1, False)]
    s = scoring.generation_summary(out.withColumn("system", F.lit("E")), "system").first()
    assert (s.n, s.mean_tokens, s.capped, s.empty) == (2, 2.0, 1, 0)
    with pytest.raises(Exception, match="empty prompt"):
        scoring.generate(spark.createDataFrame([(1, "")], "id int, p string"), "p", lambda: lambda ps: ps).collect()


def test_cache_and_reuse(spark, tmp_path):
    c = spark.createDataFrame([("a", "d", "x"), ("b", "d", "y")], "chunk_id string, doc_id string, text string")
    calls = []
    build = lambda d: (calls.append(1), d.withColumn("v", F.length("text")))[1]
    assert scoring.cached(c, "e1", str(tmp_path), build).count() == 2
    assert scoring.cached(c.orderBy(F.desc("chunk_id")), "e1", str(tmp_path), build).count() == 2 and len(calls) == 1
    assert scoring.content_key(c, "e1") != scoring.content_key(c, "e2") != scoring.content_key(c.limit(1), "e2")
    full = c.select("chunk_id").withColumn("score", F.lit(9.0))
    assert scoring.complete_scores(c, full, ["chunk_id"], F.lit(1.0)).agg(F.sum("score")).first()[0] == 18
    assert scoring.complete_scores(c, full.limit(1), ["chunk_id"], F.lit(1.0)).agg(F.sum("score")).first()[0] == 2
    with pytest.raises(ValueError):
        scoring.complete_scores(c.where("chunk_id = 'a'"), full, ["chunk_id"], F.lit(1.0))
