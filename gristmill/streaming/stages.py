"""Stages that resume (T3): outputs named by what they come from, with a mark that says when they are whole.

A stage's folder is the hash of its name, its parameters and its inputs' identities.  Every attempt writes a folder of its
own inside, and then a mark: one row, in one file, that names the attempt with the rows and the digest it wrote.  A file
appears whole or not at all, so an attempt that was killed leaves no mark and nothing reads it.  A stage is left out only
where the marked attempt still has the marked rows; otherwise it is run again.  Everything is read and written by Spark,
so the folder may be in any store.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.snapshots import digest

MARK = "attempt string, rows long, digest string"


class Output(NamedTuple):
    """What a stage gave: its rows, what identifies them, and whether they were there already."""

    rows: DataFrame
    identity: str
    resumed: bool


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of any table, whatever the order of its rows and columns."""
    # values print alike when a table is read again; maps have no order of their own
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    r = df.select(F.sha2(whole, 256).alias("h")).agg(F.count(F.lit(1)).alias("rows"), digest("h").alias("digest")).first()
    return r.rows, r.digest


class Stages:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _marks(self, folder: str) -> list:
        """A row for each attempt that came to its end."""
        try:
            return self.spark.read.schema(MARK).json(f"{folder}/marks/*").orderBy("attempt").collect()
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _whole(self, folder: str) -> tuple[DataFrame, str] | None:
        """The output of a marked attempt that still has its rows, the smallest name first."""
        for m in self._marks(folder):
            try:
                rows = self.spark.read.parquet(f"{folder}/{m.attempt}")
                if fingerprint(rows) == (m.rows, m.digest):
                    return rows, m.digest
            except (PySparkException, Py4JJavaError):  # files of it are gone or can't be read
                continue
        return None

    def source(self, df: DataFrame) -> Output:
        """An input from outside, identified by its content."""
        rows, d = fingerprint(df)
        return Output(df, f"{rows}:{d}", True)

    def run(self, name: str, build: Callable[..., DataFrame], inputs: list[Output], **parameters) -> Output:
        """The output of `build(*rows of the inputs, **parameters)`, from an earlier run if there is one."""
        key = json.dumps([name, parameters, [i.identity for i in inputs]], sort_keys=True, default=str)
        folder = f"{self.root}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"
        if found := self._whole(folder):
            return Output(found[0], f"{key}:{found[1]}", True)
        attempt = f"attempt-{uuid.uuid4().hex}"
        build(*[i.rows for i in inputs], **parameters).write.parquet(f"{folder}/{attempt}")
        rows = self.spark.read.parquet(f"{folder}/{attempt}")
        n, d = fingerprint(rows)
        self.spark.createDataFrame([(attempt, n, d)], MARK).coalesce(1).write.json(f"{folder}/marks/{attempt}")
        return Output(rows, f"{key}:{d}", False)
