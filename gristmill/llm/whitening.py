"""Whitening of embeddings by the eigenvectors of their covariance.

Every entry c becomes the whole number x = floor(64 c) + 1000000.  Sums S of all dimensions and the number n of vectors are
exact, so rows are centred exactly, n x - S, before anything is multiplied: as x - floor(S / n), a whole number, less
the rest of S / n.  `RowMatrix.computeGramianMatrix` of the centred rows, divided by n, is the covariance, which has one
number for each pair of dimensions; it comes to the driver, `eigh` gives its components there, and they are broadcast to
the rows.  The covariance of the whitened rows, the same way, tells how far it is from the identity.

Vectors are read three times: for the sums, the covariance and the whitened rows, which are written once to the shared
folder with as many numbers as there are components.

Edge cases: vectors that are null, empty, or hold a null or non-finite entry are left out, and so are vectors of another
length than most have (ties: the longer one) and vectors with an entry of 2^44 or more, whose x isn't exact; a null id
stays null; repeated rows count and are returned each; a deviation beyond a long is null; components whose eigenvalue is
no more than rounding (1e-12 of the largest) can't be whitened and are left out, so that one row, equal rows or no rows
at all give an empty result; further columns are left out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import importable
from gristmill.llm.common import bounded_batches, materialise, read

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries from here on are too large for an exact x.
LARGEST = float(1 << 44)
#: Eigenvalues up to this share of the largest are rounding.
ROUNDING = 1e-12
ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Components(NamedTuple):
    """n and S of the fit list, unit eigenvectors as columns by falling eigenvalue, and the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of all vectors that have every entry."""
    importable(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    whole = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    v = v.where(F.col("c").isNotNull() & (F.size("c") > 0) & whole)
    return v.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose x has the length of most, and that length; 0 where there is none."""
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return rows.where(F.size("x") == d), d


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, S): exact, a number for each dimension."""
    r = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]).first()
    return r.n, [int(v) for v in r[1:]]


def covariance(centred: DataFrame, column: str, n: int, d: int) -> np.ndarray:
    """Of rows that are centred already."""
    v = centred.select(array_to_vector(F.col(column)).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(v, "v"), n, d).computeGramianMatrix()
    return gram.toArray() / n


def centred(x: Column, n: int, s: list[int]) -> Column:
    """x - S / n: a whole number less a rest below one."""
    whole, rest = F.array(*[F.lit(v // n).cast("long") for v in s]), F.array(*[F.lit(v % n / n) for v in s])
    return F.zip_with(F.zip_with(x, whole, lambda a, b: (a - b).cast("double")), rest, lambda a, b: a - b)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Components | None]:
    """The usable rows and their components; None where there are no components."""
    rows, d = of_one_length(usable(vectors))
    if not d:
        return rows, None
    n, s = sums(rows, d)
    v = covariance(rows.select(centred(F.col("x"), n, s).alias("y")), "y", n, d)
    values, unit = np.linalg.eigh((v + v.T) / 2)
    values, unit = values[::-1], unit[:, ::-1]
    unit = unit * np.where(unit[np.abs(unit).argmax(0), np.arange(d)] < 0, -1.0, 1.0)  # the largest entry is positive
    real = min(components, int((values > max(values[0], 0.0) * ROUNDING).sum()))
    return (rows, Components(n, s, unit[:, :real], values[:real], float(np.trace(v)))) if real else (rows, None)


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact; None beyond a long."""
    whole = np.array([v // n for v in s], np.int64)
    off = x - whole
    most = n * (int(np.abs(off).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 63:
        off = off * n - np.array([v % n for v in s], np.int64)
        return np.einsum("ij,ij->i", off, off).tolist()
    off = off.astype(object) * n - np.array([v % n for v in s], object)
    return [t if t < 1 << 63 else None for t in (off * off).sum(1)]


def transform(rows: DataFrame, c: Components) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of usable rows."""
    sent = rows.sparkSession.sparkContext.broadcast((c.n, c.sums, c.vectors / np.sqrt(c.values)))

    def run(batches):
        n, s, turn = sent.value
        whole, rest = np.array([v // n for v in s], np.int64), np.array([v % n / n for v in s])
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["x"].to_numpy())
            y = ((x - whole).astype(float) - rest) @ turn
            yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": pd.array(deviations(x, n, s), "Int64"), "whitened": list(y)})

    bounded_batches(rows.sparkSession)
    return rows.mapInPandas(run, "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component, as ROW has it; components are numbered from 1."""
    rows, c = fit(vectors, components)
    if c is None:
        return vectors.sparkSession.createDataFrame([], ROW)
    k = len(c.values)
    turned = materialise(transform(rows, c), "whitened")
    # sums of exactly centred rows are 0, and so are those of what they are projected on
    error = float(np.abs(covariance(turned, "whitened", c.n, k) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v / c.trace)) for v in c.values])
    long = turned.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(c.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def query(spark, sf_dir):
    return whiten(read(spark, sf_dir, "embeddings"))
