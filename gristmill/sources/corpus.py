"""Nested corpora to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flatten(rows: DataFrame, domains: str = "doc_data") -> DataFrame:
    """A column map<domain, map<id, struct<title, doc_text>>> to document rows `domain::id`; ids must be unique."""
    d = rows.select(F.explode(domains).alias("domain", "documents")).select("domain", F.explode("documents").alias("raw_document_id", "d"))
    out = d.select(F.lit(1).alias("schema_version"), F.concat_ws("::", "domain", "raw_document_id").alias("document_id"), "raw_document_id", "domain", F.col("d.title").alias("title"), F.col("d.doc_text").alias("text"))
    n = F.count("*").over(W.partitionBy("document_id"))
    return out.withColumn("n", n).withColumn("document_id", F.when(F.col("n") > 1, F.raise_error(F.lit("duplicate document id"))).otherwise(F.col("document_id"))).drop("n")


def span_text(spans: Column, span_id: Column, body: Column) -> Column:
    """The text of the span with the id in array<struct<id, text, start, end>>; without a text the longer of the two
    trimmed slices that end at `end`, exclusive and inclusive. Anything but one span, or an empty one, fails the query."""
    hits = F.filter(spans, lambda s: s["id"] == span_id)
    s = F.get(hits, F.lit(0))
    outer, inner = (F.trim(F.substr(body, s["start"] + 1, s["end"] - s["start"] + more)) for more in (F.lit(1), F.lit(0)))
    text = F.coalesce(F.nullif(F.trim(s["text"]), F.lit("")), F.when(F.length(outer) > F.length(inner), outer).otherwise(inner))
    return F.when(F.size(hits) != 1, F.raise_error(F.lit("cannot resolve the span"))).when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("empty span"))).otherwise(text)
