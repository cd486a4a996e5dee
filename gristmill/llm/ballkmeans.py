"""Ball k-means on whole numbers.

Entries become floor(1024 x), so that distances, sums and means are exact.  A cluster's members are a ball around its
centroid.  In each block of vectors the ball's radius tells which other centroids are neighbours: those at most two radii
away, for by the triangle inequality no other can be as near to any member.  The neighbours by their distance cut the
ball into a stable core, nearer than half the way to the first of them, and annuli around it; members of the core stay,
and members of annulus m are compared with the first m neighbours and no others.  Comparisons are of squares: a centroid
is left out only if it is strictly farther, so ties still go to the smaller number.

Vectors are held in blocks with the cluster of each, which a round maps to the next one's, and each block gives a count
and a sum of each cluster: what goes to the driver is one row for each cluster.  Blocks of a round are kept in memory and on
disk of the executors; what is lost with one of them is computed again from the vectors and the centroids of earlier rounds.
Rounds after which no centroid moved would change nothing and are left out.

Edge cases: vectors that are null, hold a null or non-finite entry, or haven't `dimensions` entries are left out, and so
are those with an entry beyond `largest`, some 185,000 for 64 dimensions, whose distances a long might not hold; an inertia beyond a long is null; fewer vectors than clusters
give as many clusters as vectors; equal hashes at the start (repeated ids) go by the vector; a null id hashes as 'null' and
stays null; repeated rows are returned each; clusters may be empty; an empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gristmill.llm.common import map_arrow, materialise, read, schema_of

CLUSTERS, ROUNDS, SCALE, DIMENSIONS, SEED = 8, 10, 1024, 64, 3
BLOCK = "ids array<long>, x array<int>, cluster array<int>, distance array<long>, part array<struct<cluster: int, count: long, inertia: decimal(30,0), sums: array<long>>>"
ROW = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Fitted(NamedTuple):
    """Blocks with the last assignment, the final centroids, and of each cluster (count, inertia)."""

    blocks: DataFrame
    centroids: np.ndarray
    sizes: list[tuple[int, int]]


def largest(dimensions: int) -> int:
    """Entries up to here, either way, have squared distances within a long."""
    return math.isqrt(((1 << 63) - 1) // dimensions) // 2


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    fits = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= largest(dimensions) / scale))
    return v.where(F.col("c").isNotNull() & (F.size("c") == dimensions) & fits).select("vec_id", F.transform("c", lambda c: F.floor(c * scale).cast("int")).alias("x"))


def start(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of their ids, in order of the hashes."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()
    return np.array([r.x for r in first], np.int64)


def nearest(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, comparisons) of vectors that were in `cluster`, each ball by its neighbours."""

    def squares(rows: np.ndarray, c: int) -> np.ndarray:
        off = x[rows] - centroids[c]
        return np.einsum("ij,ij->i", off, off)

    out, best, compared = cluster.copy(), np.empty(len(x), np.int64), 0
    for c in np.unique(cluster):
        members = np.flatnonzero(cluster == c)
        own = squares(members, c)
        compared += len(members)
        off = centroids - centroids[c]
        half = -(-np.einsum("ij,ij->i", off, off) // 4)  # half of the way to the other centroids, squared and rounded up
        others = np.array([j for j in np.argsort(half, kind="stable") if j != c and half[j] <= own.max()], int)
        annulus = np.searchsorted(half[others], own, "right")  # so many neighbours may be as near; none: the core
        chosen, least = np.full(len(members), c), own.copy()
        for m, j in enumerate(others):
            open_ = np.flatnonzero(annulus > m)
            if not len(open_):
                break
            d = squares(members[open_], j)
            compared += len(open_)
            better = (d < least[open_]) | ((d == least[open_]) & (j < chosen[open_]))
            chosen[open_[better]], least[open_[better]] = j, d[better]
        out[members], best[members] = chosen, least
    return out, best, compared


def _parts(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int) -> list[dict]:
    out = []
    for c in range(k):
        own = cluster == c
        if own.any():
            high, low = distance[own] >> 31, distance[own] & (1 << 31) - 1  # sums of both can't overflow
            out.append({"cluster": c, "count": int(own.sum()), "inertia": Decimal((int(high.sum()) << 31) + int(low.sum())), "sums": x[own].sum(0).tolist()})
    return out


def _block(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, parts: list[dict]) -> pa.RecordBatch:
    def whole(values, kind):
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

    struct = pa.list_(pa.struct([("cluster", pa.int32()), ("count", pa.int64()), ("inertia", pa.decimal128(30, 0)), ("sums", pa.list_(pa.int64()))]))
    columns = [whole(ids, pa.int64()), whole(x.ravel(), pa.int32()), whole(cluster, pa.int32()), whole(distance, pa.int64()), pa.array([parts], struct)]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "x", "cluster", "distance", "part"])


def blocks_of(rows: DataFrame) -> DataFrame:
    """A row for each batch of vectors, all in cluster 0 and not measured yet."""
    d = rows.select("vec_id", "x")

    def run(batches):
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                yield _block(b.column(0), b.column(1).flatten().to_numpy(), np.zeros(n, np.int32), np.zeros(n, np.int64), [])

    return map_arrow(d, run, schema_of(BLOCK))


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The blocks with every vector in its nearest centroid's cluster."""
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        own = sent.value
        for b in batches:
            for i in range(b.num_rows):
                ids, x, before = (b.column(c).slice(i, 1).flatten() for c in (0, 1, 2))
                x = x.to_numpy().reshape(len(ids), -1).astype(np.int64)
                cluster, distance, _ = nearest(x, before.to_numpy(), own)
                yield _block(ids, x, cluster, distance, _parts(x, cluster, distance, len(own)))

    return map_arrow(blocks, run, schema_of(BLOCK))


def totals(blocks: DataFrame, dimensions: int) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that has members: count, inertia and sums, summed over the blocks."""
    p = blocks.select(F.explode("part").alias("p")).select("p.cluster", "p.count", "p.inertia", "p.sums")
    g = p.groupBy("cluster").agg(F.sum("count").alias("count"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dimensions)]).alias("sums"))
    return {r.cluster: (r["count"], int(r.inertia), r.sums) for r in g.collect()}


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> Fitted | None:
    """The blocks' last assignment after `rounds` of assigning and moving; None without vectors."""
    rows = usable(vectors, dimensions, scale)
    centroids = start(rows, clusters, seed)
    if not len(centroids):
        return None
    now, seen = blocks_of(rows), None
    for i in range(rounds + 1):
        after = assigned(now, centroids).persist(StorageLevel.MEMORY_AND_DISK)
        seen = totals(after, dimensions)
        if i:
            now.unpersist()
        now = after
        moved = centroids.copy()
        for c, (count, _, s) in seen.items():
            moved[c] = [v // count for v in s]
        if i == rounds or (moved == centroids).all():
            break
        centroids = moved
    return Fitted(now, centroids, [seen.get(c, (0, 0))[:2] for c in range(len(centroids))])


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each usable vector.

    The last assignment is written once to the shared folder, so that no executor has to keep it.
    """
    found = fit(vectors, clusters, rounds, dimensions, scale, seed)
    spark = vectors.sparkSession
    if found is None:
        return spark.createDataFrame([], ROW)
    rows = found.blocks.select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("r")).select(F.col("r.ids").alias("vec_id"), "r.cluster", "r.distance")
    rows = materialise(rows, "clusters")
    found.blocks.unpersist()
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    inertia = [i for _, i in found.sizes]
    held = lambda i: i if i < 1 << 63 else None
    return rows.select("vec_id", "cluster", "distance", of(map(held, inertia), "long").alias("cluster_inertia"), F.lit(held(sum(inertia))).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def query(spark, sf_dir):
    return cluster(read(spark, sf_dir, "embeddings"))
