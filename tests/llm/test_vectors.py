"""Whitening and ball k-means against plain versions written from their contracts."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from gristmill.llm import ballkmeans, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, whitened int"
SF = "/root/testdata/sf0.001"


def rows_of(n, d=64, seed=5, hot=0.0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) / math.sqrt(d)
    v[: int(n * hot)] = v[0]
    return [(i, [float(np.float32(c)) for c in v[i]], i % 3, "x", "c", 1) for i in range(n)]


ODD = [(900, None, 0, "", "", 0), (901, [], 0, "", "", 0), (902, [None] * 64, 0, "", "", 0), (903, [0.5] * 63 + [float("nan")], 0, "", "", 0), (904, [float("inf")] + [0.1] * 63, 0, "", "", 0), (905, [0.5] * 63, 0, "", "", 0)]


@pytest.fixture(scope="module")
def vectors(spark):
    """With unusable rows, a repeated row, a null id, a third of equal vectors and clashing columns."""
    rows = rows_of(200, hot=0.34)
    return spark.createDataFrame([*rows, *ODD, rows[7], rows[120], (None, *rows[130][1:])], SCHEMA).repartition(5)


def usable(df):
    return [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and len(r.embedding) == 64 and all(c is not None and math.isfinite(c) for c in r.embedding)]


# ---- whitening


def check_whitened(got, kept, components=32):
    xs = [[math.floor(64 * c) + 1000000 for c in v] for _, v in kept]
    n, d = len(xs), len(xs[0])
    s = [sum(col) for col in zip(*xs)]
    dev = sorted(((i if i is not None else -1), sum((n * a - b) ** 2 for a, b in zip(x, s))) for (i, _), x in zip(kept, xs))
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s)] for x in xs])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * min(components, d)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.deviation) for r in got if r.component == 1) == dev
    of = {}
    for r in got:
        of.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for (i, _), row in zip(kept, y):
        for k in range(min(components, d)):
            w = float(row @ u[:, k] / math.sqrt(e[k]))
            r = of[i, k + 1][0]
            if k not in signs and abs(w) > 1e-3:
                signs[k] = 1 if w * r.whitened > 0 else -1
            assert any(abs(x.whitened - signs.get(k, 1) * w) < 1e-6 for x in of[i, k + 1])
            assert r.n == n and abs(r.explained - e[k] / np.trace(v)) < 1e-9 and 0 <= r.identity_error < 1e-8


def test_whitening(vectors):
    check_whitened(whitening.whiten(vectors).collect(), usable(vectors))


def test_whitening_query(spark):
    check_whitened(whitening.query(spark, SF).collect(), usable(spark.read.parquet(f"{SF}/embeddings.parquet")))


def test_whitened_covariance_is_the_identity(vectors):
    w = {}
    for r in whitening.whiten(vectors).collect():
        w.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
    m = np.array([[x for i in sorted(w[1], key=str) for x in w[k][i]] for k in sorted(w)])
    assert np.abs(m @ m.T / m.shape[1] - np.eye(len(m))).max() < 1e-9


def test_nothing_to_whiten(spark):
    for rows in ([], ODD[:5], [(1, [0.25] * 8, 0, "", "", 0)], [(i, [0.25, 0.5], 0, "", "", 0) for i in range(4)]):
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and got.columns == [c.split()[0] for c in whitening.ROW.split(", ")]


def test_few_dimensions_and_singular(spark):
    rows = [(i, [float(i % 5), float(i % 5), float(i * i % 7)], 0, "", "", 0) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 60 and max(r.identity_error for r in got) < 1e-9


def test_lengths_of_the_minority_are_left_out(spark):
    got = whitening.whiten(spark.createDataFrame([*rows_of(20, d=4), (99, [1.0, 2.0], 0, "", "", 0)], SCHEMA)).collect()
    assert {r.vec_id for r in got} == set(range(20)) and got[0].n == 20


def test_deviations_beyond_a_word():
    x = np.array([[1 << 40, 5], [-(1 << 40), 7], [3, 1000]], np.int64)
    s = [int(v) for v in x.sum(0)]
    want = [sum((3 * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x]
    assert whitening.deviations(x, 3, s) == [v if v < 1 << 63 else None for v in want]


# ---- ball k-means


def lloyd(kept, clusters=8, rounds=10):
    xs = [[math.floor(1024 * c) for c in v] for _, v in kept]
    key = lambda i: (hashlib.sha256(f"3:{'null' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), xs[i])
    centroids = [xs[i] for i in sorted(range(len(xs)), key=key)[:clusters]]
    for i in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for x in xs]
        if i < rounds:
            for j in range(len(centroids)):
                own = [x for x, (_, k) in zip(xs, at) if k == j]
                centroids[j] = [sum(col) // len(own) for col in zip(*own)] if own else centroids[j]
    inertia = [sum(d for d, k in at if k == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), k, d, inertia[k], sum(inertia), sha[k]) for (i, _), (d, k) in zip(kept, at))


def got(df):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in df.collect())


def test_clusters(vectors):
    assert got(ballkmeans.cluster(vectors)) == lloyd(usable(vectors))


@pytest.mark.parametrize("rounds", [0, 3])
def test_fewer_rounds(vectors, rounds):
    assert got(ballkmeans.cluster(vectors, rounds=rounds)) == lloyd(usable(vectors), rounds=rounds)


def test_clusters_query(spark):
    assert got(ballkmeans.query(spark, SF)) == lloyd(usable(spark.read.parquet(f"{SF}/embeddings.parquet")))


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame(rows_of(5), SCHEMA)
    assert got(ballkmeans.cluster(few)) == lloyd(usable(few))
    none = ballkmeans.cluster(spark.createDataFrame(ODD, SCHEMA))
    assert none.count() == 0 and none.columns == [c.split()[0] for c in ballkmeans.ROW.split(", ")]


def test_repeated_ids_and_large_entries(spark):
    rows = [(i % 3, [float(185000 if (i + j) % 2 else -185000) for j in range(64)], 0, "", "", 0) for i in range(12)]
    df = spark.createDataFrame([*rows, (7, [190000.0] * 64, 0, "", "", 0)], SCHEMA)
    assert got(ballkmeans.cluster(df)) == lloyd([(i, v) for i, v, *_ in rows])


def test_ties_and_pruning():
    """On a small lattice ties abound; results are those of all comparisons, with fewer of them where balls are apart."""
    r = np.random.default_rng(1)
    for spread in (3, 40):
        for _ in range(200):
            centroids = r.integers(-spread, spread, (6, 2)) * 2
            x = r.integers(-spread, spread, (50, 2)) * 2
            every = ((x[:, None] - centroids[None]) ** 2).sum(2)
            cluster, distance, compared = ballkmeans.nearest(x, r.integers(0, 6, 50), centroids)
            assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all() and compared <= every.size
    x = np.concatenate([c + r.integers(-5, 5, (100, 2)) for c in (np.array([0, 0]), np.array([1000, 0]), np.array([0, 1000]))])
    cluster, _, compared = ballkmeans.nearest(x, np.repeat([0, 1, 2], 100), np.array([[0, 0], [1000, 0], [0, 1000]]))
    assert compared == 300 and (cluster == np.repeat([0, 1, 2], 100)).all()  # all in stable cores
