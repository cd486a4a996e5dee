"""Common candidate pools of all (query, chunker) cells in one plan.

The chunks of all chunkers are one table with the chunker's name.  Its lexical statistics, postings, vectors and lists are
keyed by that name, so one index and one job serve all cells; a further chunker is further rows, not a further loop.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gristmill.functions.text import normalize_text
from gristmill.operators.retrieval import DENSE_WEIGHT, LEXICAL_WEIGHT, SMALL, bm25, dense, fuse, md5_bucket, pool_hash, small, with_hashed_vectors

BY = ("chunker",)
#: The pool's size and the depth of both lists.
POOL, DEPTH = 20, 20


def hashed(rows: DataFrame, id_column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The stand-in encoder; a real one is a function of the same form around a model."""
    return with_hashed_vectors(rows, id_column, by=by, bucket=md5_bucket)


def lists(queries: DataFrame, chunks: DataFrame, depth: int = DEPTH, encode: Callable = hashed) -> tuple[DataFrame, DataFrame]:
    """The dense and the lexical list of each cell: (chunker, query_id, chunk_id, rank, score)."""
    d = dense(encode(queries, "query_id"), encode(chunks, "chunk_id", BY), depth, BY)
    return d, bm25(queries, chunks, depth, BY)


def candidates(found: tuple[DataFrame, DataFrame], queries: DataFrame, chunks: DataFrame, relevant: DataFrame, pool: int = POOL) -> DataFrame:
    """(query_id, chunker, fused_rank, fused_score, chunk_id, doc_id, text, token_count, grade), from `lists`.

    relevant (query_id, doc_id) are the documents that answer a query; the grade is 2 where the chunk holds the query's
    `span`, 1 where its document is relevant, else 0.
    """
    d, lexical = found
    fused = fuse([(d, DENSE_WEIGHT), (lexical, LEXICAL_WEIGHT)], pool, by=BY)
    few = small(fused, queries, SMALL // (8 * pool))  # of some chunkers; they go out to the chunks
    rows = chunks.select(*BY, "chunk_id", "doc_id", "text", "token_count").join(few, [*BY, "chunk_id"])
    rows = rows.join(small(queries.select("query_id", normalize_text("span").alias("span"))), "query_id")
    rows = rows.join(relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
    grade = F.when((F.col("span") != "") & F.contains(normalize_text("text"), F.col("span")), 2).when(F.col("hit"), 1).otherwise(0)
    return rows.select("query_id", *BY, F.col("rank").alias("fused_rank"), F.col("score").alias("fused_score"), "chunk_id", "doc_id", "text", "token_count", grade.alias("grade"))


def cells(found: tuple[DataFrame, DataFrame], pools: DataFrame) -> DataFrame:
    """A row for each cell: both lists in order, the pool's size and its hash."""
    unit = ["query_id", *BY]
    side = lambda rows, name: rows.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias(name))
    h = pool_hash(pools.withColumnRenamed("fused_rank", "rank"), tuple(unit))
    d, lexical = found
    return h.join(side(d, "dense_candidates"), unit, "left").join(side(lexical, "bm25_candidates"), unit, "left")


def incomplete(cells_: DataFrame, expected: DataFrame, pool: int = POOL) -> DataFrame:
    """Cells of `expected` (query_id, chunker) that are missing or have another number of candidates."""
    c = cells_.select("query_id", *BY, "candidate_count")
    return expected.join(c, ["query_id", *BY], "left").where(F.coalesce("candidate_count", F.lit(0)) != pool)


def write(pools: DataFrame, cells_: DataFrame, path: str, chunkers: list[str]) -> dict:
    """Write both tables below `path` and tell what an observation of the rows has seen on the way.

    seconds, by chunker, are from the start of the job to its last candidate; the job is one for all chunkers, so they
    overlap.  The digest doesn't hang on the order of rows.
    """
    clock = F.expr("java_method('java.lang.System', 'currentTimeMillis')").cast("long")
    digest = F.bit_xor(F.xxhash64("query_id", *BY, "fused_rank", "chunk_id", "grade"))
    seen, done = Observation("candidates"), Observation("cells")
    began = time.time()
    of = [m for i, c in enumerate(chunkers) for m in (F.count_if(F.col("chunker") == c).alias(f"rows_{i}"), F.max(F.when(F.col("chunker") == c, clock)).alias(f"last_{i}"))]
    pools.observe(seen, F.count(F.lit(1)).alias("candidates"), digest.alias("digest"), *of).write.parquet(f"{path}/candidates")
    cells_.observe(done, F.count(F.lit(1)).alias("cells"), F.min("candidate_count").alias("least")).write.parquet(f"{path}/cells")
    s, d = seen.get, done.get
    runtime = [{"chunker": c, "candidates": s[f"rows_{i}"], "seconds": round(s[f"last_{i}"] / 1000 - began, 3) if s[f"last_{i}"] else None} for i, c in enumerate(chunkers)]
    return {"candidates": s["candidates"], "cells": d["cells"], "smallest_pool": d["least"], "digest": s["digest"], "runtime": runtime, "seconds": round(time.time() - began, 3)}
