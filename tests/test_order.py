"""Exact percentiles and average ranks from ranges, against numpy and pandas."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import stats


@pytest.fixture(scope="module")
def rows():
    """Groups of many sizes, one with a third of all rows at one value, with nulls, infinities and a null group."""
    r = random.Random(8)
    out = [("hot", 7.5)] * 900 + [("hot", r.gauss(0, 100)) for _ in range(900)]
    out += [(f"g{i}", round(r.gauss(0, 3), r.randrange(3))) for i in range(9) for _ in range(i * i * 5 + 1)]
    out += [(None, float(i)) for i in range(6)] + [("g1", None), ("g2", float("nan")), ("g2", float("inf")), ("empty", None), ("zero", 0.0), ("zero", -0.0)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


def groups(rows, finite=True):
    out = {}
    for g, v in rows:
        out.setdefault(g, [])
        if v is not None and (not finite or math.isfinite(v)):
            out[g].append(v)
    return out


@pytest.mark.parametrize("ranges", [2, 64])
def test_percentiles(frame, rows, monkeypatch, ranges):
    monkeypatch.setattr(stats, "RANGES", ranges)
    got = {r.g: r for r in stats.summary(frame, "v", ["g"]).collect()}
    want = groups(rows)
    assert set(got) == set(want)
    for g, v in want.items():
        r = got[g]
        assert r.n == len(v) and (not v) == (r["median"] is None)
        if v:
            assert r["min"] == min(v) and r["max"] == max(v) and math.isclose(r["mean"], np.mean(v), abs_tol=1e-9)
            assert math.isclose(r["median"], np.percentile(v, 50), abs_tol=1e-9) and math.isclose(r.p95, np.percentile(v, 95), abs_tol=1e-9)


def test_interval(frame, rows):
    finite = frame.where("v is not null and not isnan(v) and abs(v) < 1e300").withColumnRenamed("v", "mean")
    v = [x for g in groups(rows).values() for x in g]
    low, high = stats.interval(finite).first()
    assert math.isclose(low, np.percentile(v, 2.5), abs_tol=1e-9) and math.isclose(high, np.percentile(v, 97.5), abs_tol=1e-9)
    assert tuple(stats.interval(finite.limit(0)).first()) == (None, None)
    one = stats.percentiles(finite.limit(1), F.col("mean"), {"p": 0.3}).collect()
    assert len(one) == 1


def test_average_ranks(frame, rows):
    got = sorted(((str(r.g), r.v, r.k) for r in stats.with_average_rank(frame.where("v is not null and not isnan(v)"), "v", ["g"], "k").collect()), key=str)
    df = pd.DataFrame([(str(g), v) for g, v in rows if v is not None and v == v], columns=["g", "v"])
    df["k"] = df.groupby("g")["v"].rank(method="average")
    assert [(g, float(v) + 0.0, k) for g, v, k in got] and sorted(((g, v + 0.0, k) for g, v, k in got), key=str) == sorted(((g, v + 0.0, k) for g, v, k in df.itertuples(index=False)), key=str)


def test_no_task_has_a_whole_group(frame):
    """Windows are by range; the only one by group runs over the counts of its ranges."""
    plan = stats.ordered(frame, F.col("v"), ["g"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "+- Window" in line or line.strip().startswith("Window")]
    assert len(windows) >= 2 and any("range" in w.split("windowspec")[0] or "range" in w for w in windows)
