"""Queries on evidence grades and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.text import normalize_text
from gristmill.operators import grading
from gristmill.plans.fragments import norm
from gristmill.plans.registry import register, table
from gristmill.plans.retrieval import GRADED, graded, ndcg_sql


@register("evidence_grades", f"WITH {GRADED} SELECT query_id, chunk_id, doc_id, rank, grade, n_relevant::BIGINT AS n_relevant FROM graded")
def evidence_grades(spark, sf_dir):
    """P3, D4."""
    return graded(spark, sf_dir).select("query_id", "chunk_id", "doc_id", "rank", "grade", F.col("n_relevant").cast("long").alias("n_relevant"))


@register(
    "grade_modes_diff",
    f"""WITH d AS (SELECT doc_id, {norm('text')} AS n FROM documents), s AS (SELECT DISTINCT {norm("split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)")} AS n FROM benchmark),
h AS (SELECT s.n AS span, count(*) AS sub, sum(contains(' ' || d.n || ' ', ' ' || s.n || ' ')::INT) AS tok FROM d JOIN s ON s.n <> '' AND contains(d.n, s.n) GROUP BY s.n)
SELECT span, sub::BIGINT AS substring_hits, tok::BIGINT AS token_hits FROM h""",
)
def grade_modes_diff(spark, sf_dir):
    """P3 against P4: the two first words of each item, as a substring and as a run of tokens, over all documents."""
    d = table(spark, sf_dir, "documents").select(normalize_text("text").alias("n"))
    first = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    return grading.hits(d, table(spark, sf_dir, "benchmark").select(normalize_text(first).alias("n")))


@register("ndcg_corrected", f"WITH {GRADED} SELECT query_id, round(ndcg, 6) AS ndcg FROM {ndcg_sql('graded')}")
def ndcg_corrected(spark, sf_dir):
    """A3: the ideal over the whole pool."""
    return grading.ndcg(graded(spark, sf_dir), ["query_id"]).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@register(
    "ndcg_legacy_vs_corrected",
    f"""WITH {GRADED}, a AS {ndcg_sql('graded')}, b AS {ndcg_sql('(SELECT * FROM graded WHERE rank <= 4)')}
SELECT query_id, round(b.ndcg, 6) AS legacy, round(a.ndcg, 6) AS corrected, round(a.ndcg - b.ndcg, 6) AS delta FROM a JOIN b USING (query_id)""",
)
def ndcg_legacy_vs_corrected(spark, sf_dir):
    """The earlier definition took the ideal from the first four alone."""
    g = graded(spark, sf_dir)
    both = grading.ndcg(g, ["query_id"]).join(grading.ndcg(g, ["query_id"], pool=False).withColumnRenamed("ndcg", "legacy"), "query_id")
    return both.select("query_id", F.round("legacy", 6).alias("legacy"), F.round("ndcg", 6).alias("corrected"), F.round(F.col("ndcg") - F.col("legacy"), 6).alias("delta"))


@register(
    "retrieval_endpoints",
    f"""WITH {GRADED}, a AS {ndcg_sql('graded')}, m AS (SELECT query_id, max((grade = 2)::INT)::DOUBLE AS visibility,
  coalesce(count(DISTINCT CASE WHEN grade >= 1 THEN doc_id END)::DOUBLE / nullif(max(n_relevant), 0), 0) AS cf, max((grade >= 1)::INT)::DOUBLE AS coverage_any, max(grade) AS maximum_grade FROM graded WHERE rank <= 4 GROUP BY query_id)
SELECT query_id, round(ndcg, 6) AS ndcg, visibility, round(cf, 6) AS coverage_fraction, coverage_any, maximum_grade FROM a JOIN m USING (query_id)""",
)
def retrieval_endpoints(spark, sf_dir):
    """A4: both readings of coverage."""
    e = grading.endpoints(graded(spark, sf_dir), ["query_id"])
    return e.select("query_id", F.round("ndcg", 6).alias("ndcg"), "visibility", F.round("coverage_fraction", 6).alias("coverage_fraction"), "coverage_any", "maximum_grade")


@register("validation_mean", f"WITH {GRADED}, a AS {ndcg_sql('graded')} SELECT round(avg(ndcg), 6) AS mean, count(*)::BIGINT AS questions, 1::BIGINT AS least_chunkers, 1::BIGINT AS most_chunkers FROM a")
def validation_mean(spark, sf_dir):
    """A5."""
    cells = grading.ndcg(graded(spark, sf_dir), ["query_id"]).withColumn("chunker", F.lit("fixed_128"))
    return grading.validation_mean(cells, "query_id", "chunker").withColumn("mean", F.round("mean", 6))


@register("grade_histogram", f"WITH {GRADED} SELECT grade, count(*)::BIGINT AS candidates, count(DISTINCT query_id)::BIGINT AS queries FROM graded GROUP BY grade")
def grade_histogram(spark, sf_dir):
    """Counted by query first."""
    return graded(spark, sf_dir).groupBy("grade", "query_id").count().groupBy("grade").agg(F.sum("count").alias("candidates"), F.count("*").alias("queries"))
