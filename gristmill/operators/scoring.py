"""Where models plug in: pair scorers, encoders and generators, and the bookkeeping around them.

A model is a function of a batch of Python values; it is made once for each Python worker and called on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.integrity import missing_cells


def pair_scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 32) -> Callable[[Column, Column], Column]:
    """A column function (query text, text) -> score; `make` loads the model in the worker."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = make()
        for q, t in parts:
            pairs = list(zip(q, t))
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in predict(pairs[i : i + batch])], dtype="float64")

    return score


def final_margin(logits: np.ndarray, mask: np.ndarray, yes: int, no: int) -> np.ndarray:
    """The yes less the no logit at each row's last token that isn't padding; a row without any token is refused."""
    held = np.asarray(mask, bool)
    if not held.any(axis=1).all():
        raise ValueError("a row holds padding alone")
    last = held.shape[1] - 1 - held[:, ::-1].argmax(axis=1)
    at = logits[np.arange(len(logits)), last]
    return at[:, yes] - at[:, no]


def probability(margin: Column) -> Column:
    """The softmax of (no, yes) is the logistic function of the margin."""
    return 1 / (1 + F.exp(-margin))


def complete_scores(candidates: DataFrame, stored: DataFrame | None, keys: list[str], score: Column) -> DataFrame:
    """Stored scores where they cover all candidates, else scores of all; keys that the candidates don't have are refused."""
    if stored is not None:
        if not stored.select(*keys).exceptAll(candidates.select(*keys)).isEmpty():
            raise ValueError("stored scores of other candidates")
        if missing_cells(stored, keys, candidates.select(*keys)).isEmpty():
            return candidates.join(stored.select(*keys, "score"), keys)
    return candidates.withColumn("score", score)


def generate(rows: DataFrame, prompt: str, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 4, cap: int | None = None) -> DataFrame:
    """`rows` with raw_output, generated_tokens and generation_length_capped, by batches; an empty prompt is refused."""

    @F.pandas_udf("raw_output string, generated_tokens int, generation_length_capped boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for p in parts:
            if p.isna().any() or (p == "").any():
                raise ValueError("empty prompt")
            texts = [t for i in range(0, len(p), batch) for t in model(list(p[i : i + batch]))]
            n = [len(t.split()) for t in texts]
            yield pd.DataFrame({"raw_output": texts, "generated_tokens": n, "generation_length_capped": [cap is not None and x >= cap for x in n]})

    return rows.withColumn("_g", run(F.col(prompt))).select(*rows.columns, "_g.*")


def generation_summary(rows: DataFrame, by: str) -> DataFrame:
    """Lengths, capped outputs and empty ones by system."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg("generated_tokens").alias("mean_tokens"),
        F.percentile("generated_tokens", 0.5).alias("median_tokens"),
        F.max("generated_tokens").alias("max_tokens"),
        F.count_if("generation_length_capped").alias("capped"),
        F.count_if(F.trim("raw_output") == "").alias("empty"),
    )


def content_key(chunks: DataFrame, encoder: str) -> str:
    """One hash of the encoder's name and every chunk; the order of rows doesn't count.

    Row hashes are summed as 128-bit halves, which needs no sort and no collection.
    """
    h = F.md5(F.concat_ws("\x1f", "chunk_id", "doc_id", "text"))
    half = lambda i: F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)"))
    r = chunks.agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b")).select(F.sha2(F.concat_ws("|", F.lit(encoder), "n", "a", "b"), 256).alias("k")).first()
    return r.k


def cached(chunks: DataFrame, encoder: str, folder: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `build` makes of the chunks, kept as Parquet under the content's hash and read from there the next time."""
    spark = chunks.sparkSession
    path = f"{folder.rstrip('/')}/{content_key(chunks, encoder)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build(chunks).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def serialise(ranked: DataFrame, by: list[str], text: bool = False) -> DataFrame:
    """Ranked rows as one array of structs for each cell, in order."""
    fields = ["rank", "chunk_id", "doc_id", "score"] + ["text"] * text
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("candidates"))
