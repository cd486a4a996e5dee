"""Resampling in blocks against plain draws of the same numbers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import stats

SEED = 7


def plain_mixed(k1, k2, draw):
    def mix(x):
        x ^= x >> 16
        x = x * 2246822507 % 2**32
        x ^= x >> 13
        x = x * 3266489909 % 2**32
        return x ^ x >> 16

    return mix(mix((k1 + draw * 2654435769) % 2**32) ^ k2)


def plain_keys(unit):
    h = hashlib.md5(f"{SEED}|{unit}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(f"f{r.randrange(60)}", "abc"[r.randrange(3)], round(r.uniform(-1, 1.2), 3)) for _ in range(400)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "family string, domain string, v double").repartition(3)


def test_numbers(spark):
    draws = [0, 1, 31, 1023, 99_999]
    k = [plain_keys(f"u{i}") for i in range(20)]
    want = [[plain_mixed(a, b, d) for d in draws] for a, b in k]
    assert stats.mixed_array(np.array([a for a, _ in k]), np.array([b for _, b in k]), np.array(draws)).tolist() == want
    df = spark.createDataFrame([(f"u{i}",) for i in range(20)], "u string")
    k1, k2 = stats.keys(SEED, F.col("u"))
    got = df.select("u", k1.alias("k1"), k2.alias("k2")).select("u", *[stats.mixed(F.col("k1"), F.col("k2"), F.lit(d)).alias(f"d{d}") for d in draws]).collect()
    assert {r.u: list(r[1:]) for r in got} == {f"u{i}": w for i, w in enumerate(want)}


def test_numbers_are_even():
    k = [plain_keys(f"u{i}") for i in range(300)]
    m = stats.mixed_array(np.array([a for a, _ in k]), np.array([b for _, b in k]), np.arange(2000))
    assert abs((m & 1).mean() - 0.5) < 0.003 and abs((m % 10).mean() - 4.5) < 0.02
    bits = (m & 1).astype(float) - 0.5
    assert np.abs(np.corrcoef(bits[:40]) - np.eye(40)).max() < 0.12 and np.abs(np.corrcoef(bits.T[:40]) - np.eye(40)).max() < 0.3


def test_sign_flips(spark, frame, rows, monkeypatch):
    draws = 5000
    s = {}
    for f, _, v in rows:
        s[f] = s.get(f, 0) + v
    t = [sum(v if plain_mixed(*plain_keys(f), d // 32) >> d % 32 & 1 == 0 else -v for f, v in s.items()) for d in range(draws)]
    monkeypatch.setattr(stats, "UNITS", 7)
    got = {r.draw: r.t for r in stats.sign_flips(stats.families(frame, "v", "family"), "family", draws, SEED).collect()}
    assert sorted(got) == list(range(draws)) and all(abs(got[d] - t[d]) < 1e-9 for d in got)
    p = stats.sign_flip_p(frame, "v", "family", draws, SEED).first()
    total = sum(s.values())
    assert p.draws == draws and abs(p.p - (1 + sum(abs(round(x, 9)) >= abs(round(total, 9)) for x in t)) / (draws + 1)) < 1e-12
    assert abs(p.observed - total / len(rows)) < 1e-12
    zero = stats.sign_flip_p(frame.withColumn("v", F.lit(0.0)), "v", "family", 100, SEED).first()
    assert (zero.draws, zero.p) == (100, 1.0)


def test_families_are_numbered_without_gaps(frame, rows):
    n = stats.numbered(stats.families(frame, "v", "family", "domain"), "family", "domain").collect()
    for d in "abc":
        own = sorted({f for f, g, _ in rows if g == d}, key=lambda f: (hashlib.md5(f.encode()).hexdigest(), f))
        assert [round(r.s, 9) for r in sorted((r for r in n if r.domain == d), key=lambda r: r.i)] == [round(sum(v for f, g, v in rows if (f, g) == (x, d)), 9) for x in own]
        assert all(r.size == len(own) for r in n if r.domain == d)


def test_bootstrap(frame, rows, monkeypatch):
    draws, cells = 3000, {}
    for f, d, v in rows:
        s, n = cells.setdefault(d, {}).get(f, (0, 0))
        cells[d][f] = (s + v, n + 1)
    order = {d: [c[f] for f in sorted(c, key=lambda f: (hashlib.md5(f.encode()).hexdigest(), f))] for d, c in cells.items()}
    want = []
    for draw in range(draws):
        took = [own[plain_mixed(*plain_keys(f"{d}:{i}"), draw) % len(own)] for d, own in order.items() for i in range(len(own))]
        want.append(sum(s for s, _ in took) / sum(n for _, n in took))
    for held in (stats.HELD, 5):  # in blocks, and by a join
        monkeypatch.setattr(stats, "HELD", held)
        got = {r.draw: r.mean for r in stats.bootstrap(frame, "v", "family", "domain", draws, SEED).collect()}
        assert sorted(got) == list(range(draws)) and all(abs(got[d] - want[d]) < 1e-9 for d in got)
    low, high = stats.interval(stats.bootstrap(frame, "v", "family", "domain", draws, SEED)).first()
    assert abs(low - np.percentile(want, 2.5)) < 1e-9 and abs(high - np.percentile(want, 97.5)) < 1e-9


def plain_means(rows, draws):
    """As the SQL has it: a family without a value has no sum but its documents count; null families are numbered last."""
    cells = {}
    for f, d, v in rows:
        s, n = cells.setdefault(d, {}).get(f, (None, 0))
        cells[d][f] = ((s or 0) + v if v is not None else s, n + 1)
    cells.pop(None, None)
    order = {d: [c[f] for f in sorted(c, key=lambda f: (f is None, hashlib.md5(str(f).encode()).hexdigest()))] for d, c in cells.items()}
    for draw in range(draws):
        took = [own[plain_mixed(*plain_keys(f"{d}:{i}"), draw) % len(own)] for d, own in order.items() for i in range(len(own))]
        sums = [s for s, _ in took if s is not None]
        yield sum(sums) / sum(n for _, n in took) if sums else None


@pytest.mark.parametrize("odd", ["", "nulls", "infinite"])
def test_bootstrap_holds_a_part_of_a_domain_at_once(spark, rows, monkeypatch, odd):
    mine = list(rows)
    if odd == "nulls":
        mine += [(None, "a", 0.5), ("f1", None, 3.0), ("only", "b", None), ("f2", "b", None), ("lone", "z", None)]
    if odd == "infinite":
        mine = [("x", "a", float("inf")), ("y", "a", 0.25), ("z", "a", None)]
    want = list(plain_means(mine, 700))
    frame = spark.createDataFrame(mine, "family string, domain string, v double").repartition(3)
    monkeypatch.setattr(stats, "CHUNK", 4)
    monkeypatch.setattr(stats, "BLOCK", 64)
    for held in (1 << 20, 8):
        monkeypatch.setattr(stats, "HELD", held)
        df = stats.bootstrap(frame, "v", "family", "domain", 700, SEED)
        got = {r.draw: r.mean for r in df.collect()}
        assert sorted(got) == list(range(700))
        assert all(got[d] == x or abs(got[d] - x) < 1e-9 for d, x in enumerate(want))
    assert odd != "infinite" or None in want and len(set(want)) > 4
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]  # no row for a draw of a family


def test_a_family_is_drawn_more_often_than_a_byte_holds(monkeypatch):
    monkeypatch.setattr(stats, "mixed_block", lambda k1, k2, steps: np.zeros(np.broadcast_shapes(k1.shape, steps.shape), np.uint32))
    sums = np.zeros((3, 10))
    own = np.array([[0.5, *[9.0] * 299], [2.0, *[9.0] * 299], [1.0] * 300])
    stats.drawn(sums, "d", 300, 0, own, range(2, 9), SEED, 1 << 20, 64)
    assert sums[:, 2:9].tolist() == [[150.0] * 7, [600.0] * 7, [300.0] * 7] and not sums[:, [0, 1, 9]].any()
