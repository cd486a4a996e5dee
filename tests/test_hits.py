"""Substring and token hits in one pass, and the normalisation that it rests on."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gristmill.functions import text
from gristmill.operators import grading


@pytest.mark.parametrize("block", [2000, 4])
def test_hits_as_looking_everywhere(spark, monkeypatch, block):
    monkeypatch.setattr(grading, "SPAN_BLOCK", block)
    r = random.Random(4)
    words = ["a", "ab", "abc", "b", "ba", "cab", "é", "x1"]
    draw = lambda n: " ".join(r.choices(words, k=r.randrange(n)))
    texts, spans = [draw(25) for _ in range(150)] + ["", "ab", None], [draw(4) for _ in range(60)] + ["", "zz zz", "b a", "b a"]
    held = {s: [t for t in texts if t is not None and s in t] for s in set(spans) - {""}}
    want = sorted((s, len(t), sum(f" {s} " in f" {x} " for x in t)) for s, t in held.items() if t)
    got = grading.hits(spark.createDataFrame([(t,) for t in texts], "n string").repartition(3), spark.createDataFrame([(s,) for s in spans], "n string"))
    assert sorted(map(tuple, got.collect())) == want and any(b < a for _, a, b in want)


def test_texts_are_read_once(spark, sf):
    df = __spark_entry__.queries()["grade_modes_diff"](spark, sf)
    assert df._jdf.queryExecution().executedPlan().toString().count("documents.parquet") == 1


def test_normalisation_as_by_plain_patterns(spark):
    r = random.Random(6)
    bits = ["a", "an", "the", "then", "tha", "at", "na", "A", "The", "é", "aé", "a_b", "1a", "-a-", "'", " ", " ", "  ", "\t", "\n ", " \n", "\xa0", "　", "\x85", "\x1c", "​"]
    rows = [("".join(r.choices(bits, k=r.randrange(12))),) for _ in range(5000)] + [(None,)]
    bare = F.translate(F.lower("t"), text.PUNCTUATION, "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))
    assert spark.createDataFrame(rows, "t string").where(~text.normalize_text("t").eqNullSafe(plain)).count() == 0
