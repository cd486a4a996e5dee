"""Containment joins, evidence grades and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.operators.retrieval import SMALL

SPAN_BLOCK = 2000


def anchor(span: Column, whole_tokens: bool) -> Column:
    """The longest token of a span that a text which holds the span must have as a token; null where there is none.

    Inside words, the first and the last token of a span may be ends of longer ones, so those between count. Long tokens
    are seldom frequent; of equal ones the first in order is taken.
    """
    tokens = F.array_remove(F.split(span, " "), "")
    sure = tokens if whole_tokens else F.when(F.size(tokens) > 2, F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(1))))
    return F.array_max(F.transform(sure, lambda t: F.struct(F.length(t).alias("length"), t.alias("token"))))["token"]


def containment(texts: DataFrame, spans: DataFrame, text_id: str, span_id: str, whole_tokens: bool = False) -> DataFrame:
    """(text_id, span_id) where the normalised text n holds the normalised span n.

    Equal spans are tested once. A text meets only the spans whose anchor is one of its tokens, and those are verified on
    the text. Up to SMALL spans go out to the texts, which are read once in place; beyond, tokens are joined with anchors
    and the texts, whose ids then have to differ, come to the pairs that are left. Spans without an anchor, of a word or
    two, meet the texts in blocks.
    """
    own = spans.where("n <> ''").groupBy("n").agg(F.collect_list(span_id).alias("ids")).withColumn("anchor", anchor(F.col("n"), whole_tokens))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" ")) if whole_tokens else c
    holds = F.contains(padded(F.col("n")), padded(F.col("span")))
    long = own.where("anchor is not null").select("anchor", F.col("n").alias("span"), "ids")
    token = F.explode(F.array_distinct(F.split("n", " "))).alias("anchor")
    if long.limit(SMALL + 1).count() <= SMALL:
        hits = texts.select(text_id, "n", token).join(F.broadcast(long), "anchor").where(holds)
    else:
        pairs = texts.select(text_id, token).join(long, "anchor")
        hits = pairs.join(texts.select(text_id, "n"), text_id).where(holds).dropDuplicates([text_id, "span"])
    found = hits.select(text_id, F.explode("ids").alias(span_id))
    if whole_tokens:
        return found
    short = own.where("anchor is null").select("n", "ids")
    count = short.count()
    block = F.pmod(F.xxhash64("n"), F.lit(max(1, -(-count // SPAN_BLOCK))))
    blocks = short.groupBy(block.alias("block")).agg(F.collect_list(F.struct("n", "ids")).alias("spans")).select("spans")
    blocks = F.broadcast(blocks) if count <= SMALL else blocks
    held = texts.crossJoin(blocks).select(text_id, F.explode(F.filter("spans", lambda s: F.contains(F.col("n"), s["n"]))).alias("s"))
    return found.unionByName(held.select(text_id, F.explode("s.ids").alias(span_id))) if count else found


def hits(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """P3 against P4: (span, substring_hits, token_hits) of each distinct normalised span n that a normalised text n holds.

    A run of tokens is a substring too, so both are told in one pass, on texts that are normalised once and stay in place.
    """
    padded = F.concat(F.lit(" "), "n", F.lit(" ")).alias("padded")
    own = spans.where("n <> ''").select("n").distinct().select("n", padded)
    count = own.count()
    block = F.pmod(F.xxhash64("n"), F.lit(max(1, -(-count // SPAN_BLOCK))))
    blocks = own.groupBy(block.alias("block")).agg(F.collect_list(F.struct("n", "padded")).alias("spans")).select("spans")
    blocks = F.broadcast(blocks) if count <= SMALL else blocks
    held = F.filter("spans", lambda s: F.contains(F.col("n"), s["n"]))
    told = F.transform(held, lambda s: F.struct(s["n"].alias("span"), F.contains(F.col("padded"), s["padded"]).cast("long").alias("token")))
    rows = texts.where("n is not null").select("n", padded).crossJoin(blocks).select(F.explode(told).alias("x")).select("x.*")
    return rows.groupBy("span").agg(F.count("*").alias("substring_hits"), F.sum("token").alias("token_hits"))


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade.cast("double")) - 1


def dcg(grade: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, gain(grade) / F.log2(rank + 1.0)).otherwise(0.0))


def check_grades(rows: DataFrame, grade: str = "grade") -> DataFrame:
    """A3: all grades must be finite and non-negative, beyond the first k too; else the query fails."""
    g = F.col(grade).cast("double")
    bad = g.isNull() | F.isnan(g) | (g < 0) | (g == float("inf"))
    return rows.withColumn(grade, F.when(bad, F.raise_error(F.lit("Grades must be finite and non-negative"))).otherwise(F.col(grade)))


def ndcg(rows: DataFrame, by: list[str], k: int = 4, pool: bool = True) -> DataFrame:
    """A3: rows (by, rank, grade) to (by, ndcg). The ideal order is over the whole pool; with pool=False over the first k
    alone, the earlier definition that A21 corrects. An ideal of 0 gives 0."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = check_grades(rows)
    if not pool:
        rows = rows.where(F.col("rank") <= k)
    best = W.partitionBy(*by).orderBy(F.desc("grade"), "rank")
    ideal = rows.withColumn("ideal_rank", F.row_number().over(best))
    sums = ideal.groupBy(*by).agg(dcg(F.col("grade"), F.col("rank"), k).alias("dcg"), dcg(F.col("grade"), F.col("ideal_rank"), k).alias("idcg"))
    return sums.select(*by, F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def endpoints(rows: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """A4: NDCG, visibility (any grade 2), coverage by the fraction of relevant documents and by any, highest grade, all at k.

    rows: (by, rank, grade, doc_id, n_relevant).
    """
    top = rows.where(F.col("rank") <= k)
    relevant = F.col("grade") >= 1
    m = top.groupBy(*by).agg(
        F.max((F.col("grade") == 2).cast("double")).alias("visibility"),
        F.coalesce(F.try_divide(F.count_distinct(F.when(relevant, F.col("doc_id"))).cast("double"), F.max("n_relevant")), F.lit(0.0)).alias("coverage_fraction"),
        F.max(relevant.cast("double")).alias("coverage_any"),
        F.max("grade").alias("maximum_grade"),
    )
    return ndcg(rows, by, k).join(m, by)


def validation_mean(cells: DataFrame, question: str, chunker: str, metric: str = "ndcg") -> DataFrame:
    """A5: cell values to question means to their mean; every question must have every chunker."""
    per = cells.groupBy(question).agg(F.avg(metric).alias("m"), F.count_distinct(chunker).alias("chunkers"))
    return per.agg(F.avg("m").alias("mean"), F.count("*").alias("questions"), F.min("chunkers").alias("least_chunkers"), F.max("chunkers").alias("most_chunkers"))
