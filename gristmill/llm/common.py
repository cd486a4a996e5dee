"""Shared plumbing: the shared folder, tables written there, and document input.

All operators read their input through `documents()`: the integer `doc_id` and the `text` alone, so that further
columns, whatever their names, never reach an operator's plan.
"""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import bounded_batches, importable, shared_dir


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: it is computed once, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gristmill/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: only then does Spark drop broadcasts and shuffle files of steps gone by."""
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow` in bounded batches; when a task ends its worker, which later stages use again, gives free memory back."""
    bounded_batches(df.sparkSession)

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string), a null text as the empty one."""
    importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def as_bytes(docs: DataFrame, *more: Column) -> DataFrame:
    """`documents()` with the text as UTF-8 bytes, for Arrow functions."""
    d = documents(docs)
    return d.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def remainder(by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
