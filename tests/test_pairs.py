"""Batched pair scores against single ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import answers
from gristmill.functions.tokens import WordTokenizer
from gristmill.operators import pairs
from gristmill.plans import chunks as plans
from gristmill.plans import registry
from gristmill.plans.retrieval import overlap_model

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(50)]
TOK = WordTokenizer(WORDS)



def model():
    """Logits that hang on every id and its place from the end, so that padding or order mistakes show."""

    def logits(ids, mask):
        held = ids * mask
        weight = np.arange(ids.shape[1], 0, -1) ** 0.5
        out = np.zeros((*ids.shape, 60))
        out[:, -1, 3] = (held * weight).sum(1) / 1000
        out[:, -1, 5] = mask.sum(1) / 100
        return out

    return logits


def single(tok, text, make, yes, no, limit):
    prompt = pairs.encoded_bodies(tok, [text], limit)
    ids, mask = pairs.padded(prompt)
    last = make()(ids, mask)[0, -1]
    return float(last[yes] - last[no]), len(prompt[0])


@pytest.fixture(scope="module")
def data():
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randrange(6))), " ".join(r.choices(WORDS, k=r.randrange(90)))) for i in range(400)]
    return [*rows, (500, None, "w1"), (501, "w1", None), (3, "w2 w3", "w4")]


@pytest.mark.parametrize("batch,window,limit", [(1, 4096, 512), (7, 50, 60), (32, 33, 40)])
def test_scores_are_those_of_single_pairs(spark, data, batch, window, limit):
    df = spark.createDataFrame(data, "i int, q string, d string").repartition(3)
    rendered = {(r.i, r.q, r.d): r.b for r in df.select("i", "q", "d", answers.fill(answers.PAIR, i=F.lit("rate"), q=F.coalesce("q", F.lit("")), d=F.coalesce("d", F.lit(""))).alias("b")).collect()}
    scored, seen = pairs.score_pairs(df, ["i", "q", "d"], F.col("q"), F.col("d"), F.lit("rate"), TOK, model, 3, 5, limit=limit, batch=batch, window=window)
    got = scored.collect()
    assert len(got) == len(data)
    for r in got:
        margin, n = single(TOK, rendered[r.i, r.q, r.d], model, 3, 5, limit)
        assert math.isclose(r.score_margin, margin, abs_tol=1e-9) and r.n_tokens == n <= limit
        assert math.isclose(r.score_probability, 1 / (1 + math.exp(-margin)), abs_tol=1e-12)
    t = pairs.trace(seen)
    assert t["pairs"] == len(data) and 0 < t["steady_pairs"] < len(data) and t["seconds"] >= t["steady_seconds"] > 0
    assert math.isclose(t["steady_pairs_per_second"], t["steady_pairs"] / t["steady_seconds"]) and 0 < t["first_batch_seconds"] <= t["seconds"]
    assert t["batches"] >= -(-len(data) // batch)


def test_batches():
    prompts = [[1] * n for n in (3, 9, 1, 9, 4)]
    assert [b.tolist() for b in pairs.batches_by_length(prompts, 2)] == [[1, 3], [4, 0], [2]]
    ids, mask = pairs.padded([[7, 8], [9]])
    assert ids.tolist() == [[7, 8], [0, 9]] and mask.tolist() == [[1, 1], [0, 1]]
    with pytest.raises(ValueError):
        pairs.encoded_bodies(TOK, ["x"], 3)


def test_one_batch_and_none(spark):
    df = spark.createDataFrame([(1, "w1", "w2")], "i int, q string, d string").coalesce(1)
    scored, seen = pairs.score_pairs(df, ["i"], F.col("q"), F.col("d"), F.lit("x"), TOK, model, 3, 5)
    scored.collect()
    t = pairs.trace(seen)
    assert t["pairs"] == t["steady_pairs"] == 1 and t["steady_pairs_per_second"] == t["pairs_per_second"]
    scored, seen = pairs.score_pairs(df.limit(0), ["i"], F.col("q"), F.col("d"), F.lit("x"), TOK, model, 3, 5)
    assert scored.count() == 0 and pairs.trace(seen)["pairs_per_second"] is None


def test_query(spark):
    got = registry.QUERIES["pair_scores"](spark, SF).collect()
    assert len(got) == 20 * spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").count()
    chunks = {r.chunk_id: r.text for r in registry_chunks(spark)}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = spark.createDataFrame([(r.query_id, r.chunk_id, items[r.query_id], chunks[r.chunk_id]) for r in got], "q long, c string, t string, d string")
    rendered = {(r.q, r.c): r.b for r in rows.select("q", "c", answers.fill(answers.PAIR, i=F.lit("Tell whether the document answers the query."), q=F.col("t"), d=F.col("d")).alias("b")).collect()}
    tok = plans.tokenizer()
    for r in got[::5]:
        margin, n = single(tok, rendered[r.query_id, r.chunk_id], overlap_model, 1, 0, pairs.LIMIT)
        assert math.isclose(r.score_margin, margin, abs_tol=1e-8) and r.n_tokens == n


def registry_chunks(spark):
    from gristmill.plans.fragments import fixed_128

    return fixed_128(spark, SF).collect()
