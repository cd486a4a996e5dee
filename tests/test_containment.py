"""Containment by anchors against looking everywhere."""

import random

import pytest

from gristmill.operators import grading


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("most", [10_000, 3])
def test_as_looking_everywhere(spark, monkeypatch, whole, most):
    r = random.Random(2)
    words = ["a", "ab", "abc", "b", "ba", "cab", "é", "x1"]
    draw = lambda n: " ".join(r.choices(words, k=r.randrange(n)))
    texts = [(i, draw(25)) for i in range(150)] + [(900, ""), (901, "ab"), (902, "ab ab")]
    spans = [(i, draw(6)) for i in range(60)] + [(900, ""), (901, texts[3][1]), (902, texts[3][1]), (903, "b a"), (904, "zz zz zz zz")]
    monkeypatch.setattr(grading, "SMALL", most)
    pad = (lambda x: f" {x} ") if whole else (lambda x: x)
    want = sorted((t, s) for t, x in texts for s, y in spans if y and pad(y) in pad(x))
    got = grading.containment(spark.createDataFrame(texts, "t int, n string").repartition(3), spark.createDataFrame(spans, "s int, n string"), "t", "s", whole)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_short_spans_alone(spark):
    t = spark.createDataFrame([(1, "one two three")], "t int, n string")
    one = grading.containment(t, spark.createDataFrame([(1, "ne tw")], "s int, n string"), "t", "s")
    assert [tuple(r) for r in one.collect()] == [(1, 1)]
    assert grading.containment(t, spark.createDataFrame([], "s int, n string"), "t", "s").count() == 0
