"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.plans.fragments import lexical, norm, norm_tokens
from gristmill.plans.registry import register, table


@register("normalize_text", f"SELECT doc_id, md5({norm('text')}) AS norm_md5, length({norm('text')})::BIGINT AS norm_chars FROM documents")
def normalize_text(spark, sf_dir):
    """P1 over all documents."""
    n = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("n"))
    return n.select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").cast("long").alias("norm_chars"))


@register("lexical_tokens", f"SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT doc_id)::BIGINT AS holders FROM (SELECT doc_id, unnest({lexical('text')}) AS term FROM documents) GROUP BY term")
def lexical_tokens(spark, sf_dir):
    """The vocabulary of all documents; counted within a document first, so that no distinct count needs a shuffle of its own."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lexical_tokens("text")).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("holders"))


TURNS = """t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS question, next_text AS answer FROM t WHERE role = 'user' AND next_role = 'assistant')"""


def pairs(spark, sf_dir):
    """User turns followed by an assistant turn."""
    from gristmill.operators.dialogue import transitions

    return transitions(table(spark, sf_dir, "conversations"), agent="assistant").select("conv_id", "turn", F.col("text").alias("question"), F.col("target").alias("answer"))


F1 = f"""SELECT conv_id, turn, len(a)::INT AS n_answer, len(b)::INT AS n_question, s::INT AS shared,
  round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2 * s::DOUBLE / (len(a) + len(b)) END::DOUBLE, 9) AS f1
FROM (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) AS s
  FROM (SELECT conv_id, turn, {norm_tokens('answer')} AS a, {norm_tokens('question')} AS b FROM p))"""


@register("token_f1_pairs", f"WITH {TURNS} {F1}")
def token_f1_pairs(spark, sf_dir):
    """A1: each answer against the question before it."""
    t = pairs(spark, sf_dir).select("conv_id", "turn", T.normalized_tokens("answer").alias("a"), T.normalized_tokens("question").alias("b"))
    return t.select("conv_id", "turn", F.size("a").alias("n_answer"), F.size("b").alias("n_question"), T.shared_tokens(F.col("a"), F.col("b")).alias("shared"), F.round(T.f1_of_tokens(F.col("a"), F.col("b")), 9).alias("f1"))


@register(
    "best_f1_em",
    f"""WITH {TURNS}, r AS (SELECT x.conv_id, x.turn, x.answer, y.answer AS ref FROM p x LEFT JOIN p y ON x.conv_id = y.conv_id AND y.turn > x.turn),
n AS (SELECT conv_id, turn, ref IS NULL AS none, {norm_tokens('answer')} AS a, {norm_tokens("coalesce(ref, '')")} AS b FROM r),
s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) AS s FROM n),
v AS (SELECT conv_id, turn, CASE WHEN none THEN (len(a) = 0)::INT::DOUBLE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2 * s::DOUBLE / (len(a) + len(b)) END AS f1,
  CASE WHEN none THEN (len(a) = 0) ELSE array_to_string(a, ' ') = array_to_string(b, ' ') END::INT::DOUBLE AS em, none FROM s)
SELECT conv_id, turn, round(max(f1)::DOUBLE, 9) AS best_f1, max(em) AS best_exact_match, sum((NOT none)::INT)::INT AS n_references FROM v GROUP BY conv_id, turn""",
)
def best_f1_em(spark, sf_dir):
    """A1, A2: each answer against all later answers of its conversation; the last one has no reference."""
    from pyspark.sql import Window as W

    later = W.partitionBy("conv_id").orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    r = pairs(spark, sf_dir).withColumn("refs", F.collect_list("answer").over(later))
    return r.select("conv_id", "turn", F.round(T.best_f1("answer", F.col("refs")), 9).alias("best_f1"), T.best_exact_match("answer", F.col("refs")).alias("best_exact_match"), F.size("refs").alias("n_references"))


@register(
    "contains_token_seq",
    f"""WITH d AS (SELECT doc_id, ' ' || {norm('text')} || ' ' AS n FROM documents), b AS (SELECT item_id, {norm('text')} AS n FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON b.n <> '' AND contains(d.n, ' ' || b.n || ' ')""",
)
def contains_token_seq(spark, sf_dir):
    """Which documents hold which item as a run of tokens; the items are the stated query set."""
    from gristmill.operators.grading import containment

    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("n"))
    b = table(spark, sf_dir, "benchmark").select("item_id", T.normalize_text("text").alias("n"))
    return containment(d, b, "doc_id", "item_id", whole_tokens=True)
