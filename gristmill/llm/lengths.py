"""Exact length histogram of encoded documents.

Documents are encoded once and counted by their number of tokens; everything else comes from that histogram, whose rows
are at most the longest length plus one.  For a context limit L, the documents longer than L and their tokens are suffix
sums, so the truncated total is (tokens of documents up to L) + L x (documents longer than L), and a quantile is the first
length whose documents up to it reach the share asked for.

The sums run in blocks of BLOCK lengths with block totals added, so no window holds the whole histogram.

Edge cases: null and empty texts have length 0; equal lengths share a row; repeated rows count each; an empty table
gives an empty histogram, and answers of 0 with null quantiles; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm.bpe import token_counts
from gristmill.llm.common import materialise, read

BLOCK = 2048


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, docs) of (doc_id, n_tokens)."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with totals up to and beyond each length; each row answers the context limit of its length.

    context_limit, docs (of that length), docs_over and tokens_over (longer ones), truncated_tokens (sum of
    min(length, limit)), total_docs, total_tokens, quantile (share of documents up to the limit).
    """
    h = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    s = h.withColumns({"d_in": F.coalesce(F.sum("docs").over(inside), F.lit(0)), "t_in": F.coalesce(F.sum("tokens").over(inside), F.lit(0))}).join(blocks, "block")
    over, tokens_over = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return s.select(
        F.col("n_tokens").alias("context_limit"),
        "docs",
        over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        (F.col("total_tokens") - tokens_over + F.col("n_tokens") * over).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        F.round((F.col("total_docs") - over) / F.col("total_docs"), 9).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, tokens_over, truncated_tokens) for any limits of 0 or more: one pass over the histogram."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "asked long")
    longer = F.col("context_limit") > F.col("asked")
    joined = asked.join(sums.select("context_limit", "docs"), F.lit(True), "left")
    size = F.col("context_limit") * F.col("docs")
    return joined.groupBy(F.col("asked").alias("context_limit")).agg(
        F.coalesce(F.sum(F.when(longer, F.col("docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.when(longer, size)), F.lit(0)).alias("tokens_over"),
        F.coalesce(F.sum(F.when(longer, F.col("docs") * F.col("asked")).otherwise(size)), F.lit(0)).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The smallest length that this share of the documents doesn't exceed."""
    row = sums.agg(*[F.min(F.when(F.col("total_docs") - F.col("docs_over") >= q * F.col("total_docs"), F.col("context_limit"))).alias(f"q{i}") for i, q in enumerate(shares)]).first()
    return dict(zip(shares, row))


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Suffix sums of the encoded lengths of `docs`; the histogram is written once to the shared folder."""
    return suffix_sums(materialise(histogram(token_counts(docs, path)), "lengths"))


def query(spark, sf_dir):
    return token_lengths(read(spark, sf_dir, "documents"))
