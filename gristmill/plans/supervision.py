"""Queries on supervision groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.text import words
from gristmill.operators import supervision as S
from gristmill.plans.fragments import norm, words as sql_words
from gristmill.plans.registry import register, table
from gristmill.plans.retrieval import GRADED, graded

#: Candidates of two chunkers: those of the pool, and each again one rank later under another chunker's name.
ROWS = f"""{GRADED}, rows AS (SELECT query_id, 'fixed_254' AS chunker, chunk_id, doc_id, rank AS fused_rank, text, grade FROM graded UNION ALL
  SELECT query_id, 'fixed_128', 'again::' || chunk_id, doc_id, rank, text, CASE WHEN rank % 3 = 0 THEN 2 ELSE grade END FROM graded),
n AS (SELECT *, {norm('text')} AS norm FROM rows)"""


def candidate_rows(spark, sf_dir):
    g = graded(spark, sf_dir).select("query_id", "chunk_id", "doc_id", F.col("rank").alias("fused_rank"), "text", "grade")
    again = g.withColumn("chunk_id", F.concat(F.lit("again::"), "chunk_id")).withColumn("grade", F.when(F.col("fused_rank") % 3 == 0, 2).otherwise(F.col("grade")))
    return g.withColumn("chunker", F.lit("fixed_254")).unionByName(again.withColumn("chunker", F.lit("fixed_128")))


@register("dedup_label_blind", f"WITH {ROWS} SELECT query_id, chunk_id, chunker, fused_rank, grade FROM n QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY fused_rank, chunker, chunk_id, doc_id) = 1")
def dedup_label_blind(spark, sf_dir):
    """D1."""
    return S.dedup_label_blind(candidate_rows(spark, sf_dir)).select("query_id", "chunk_id", "chunker", "fused_rank", "grade")


@register("dedup_grade_first", f"WITH {ROWS} SELECT query_id, chunk_id, chunker, fused_rank, grade FROM n WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY grade DESC, fused_rank, CASE chunker WHEN 'fixed_128' THEN 0 WHEN 'fixed_254' THEN 1 ELSE 4 END, chunk_id) = 1")
def dedup_grade_first(spark, sf_dir):
    """D2, O3."""
    return S.dedup_grade_first(candidate_rows(spark, sf_dir)).select("query_id", "chunk_id", "chunker", "fused_rank", "grade")


GROUPS = f"""{GRADED}, m AS (SELECT *, max(grade) OVER (PARTITION BY query_id) AS top FROM graded),
neg AS (SELECT query_id, list(chunk_id ORDER BY place) AS ids, list(text ORDER BY place) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM m WHERE top > 0 AND grade < top) WHERE place <= 7 GROUP BY query_id),
grp AS (SELECT query_id, grade AS positive_grade, chunk_id AS positive_chunk_id, text AS positive_text, ids, texts FROM m JOIN neg USING (query_id) WHERE top > 0 AND grade = top)"""


def groups(spark, sf_dir):
    return S.listwise_groups(graded(spark, sf_dir).withColumnRenamed("rank", "fused_rank"))


@register("listwise_groups", f"WITH {GROUPS} SELECT query_id, positive_grade, positive_chunk_id, len(ids)::INT AS n_negatives, array_to_string(ids, '|') AS negatives FROM grp")
def listwise_groups(spark, sf_dir):
    """D3."""
    return groups(spark, sf_dir).select("query_id", "positive_grade", "positive_chunk_id", F.size("negative_chunk_ids").alias("n_negatives"), F.array_join("negative_chunk_ids", "|").alias("negatives"))


@register(
    "prune_pairs",
    f"""WITH {GROUPS}, l AS (SELECT *, len({sql_words('positive_text')}) + 12 AS pl, list_transform(texts, lambda t: length(t) // 6 + 12) AS nl FROM grp),
k AS (SELECT *, [i FOR i IN range(1, len(ids) + 1) IF nl[i] <= 135] AS keep FROM l),
r AS (SELECT *, CASE WHEN pl > 140 THEN 'overlength_positive_pair' WHEN pl > 135 THEN 'overlength_positive_pair' WHEN len(keep) = 0 THEN 'no_surviving_negative_pair' END AS reason FROM k)
SELECT query_id, positive_chunk_id, CASE WHEN reason IS NULL THEN 'retained' ELSE 'excluded' END AS status, reason, pl::INT AS positive_length,
  CASE WHEN reason IS NULL THEN array_to_string(list_transform(keep, lambda i: ids[i]), '|') END AS kept FROM r""",
)
def prune_pairs(spark, sf_dir):
    """A pair is as long as its words, for negatives a sixth of its characters, and 12 for the template."""
    lengths = F.transform("negative_texts", lambda t: F.floor(F.length(t) / 6).cast("int") + 12)
    p = S.prune_pairs(groups(spark, sf_dir), F.size(words("positive_text")) + 12, lengths, 135)
    return p.select("query_id", "positive_chunk_id", "status", "reason", "positive_length", F.array_join("kept_chunk_ids", "|").alias("kept"))


@register(
    "listwise_loss",
    """WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS position, l_discount * 10 AS score FROM lineitem), g AS (SELECT l_orderkey, max(score) AS top, count(*) AS size, min(position) AS first FROM s GROUP BY l_orderkey),
x AS (SELECT l_orderkey, max(size) AS size, ln(sum(exp(score - top))) + max(top) - max(CASE WHEN position = first THEN score END) AS loss FROM s JOIN g USING (l_orderkey) WHERE size >= 2 GROUP BY l_orderkey)
SELECT size::BIGINT AS size, count(*)::BIGINT AS groups, round(avg(loss), 6) AS mean_loss FROM x GROUP BY size""",
)
def listwise_loss(spark, sf_dir):
    """Orders as groups, their first line as the positive."""
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("score"), "l_linenumber")
    whole = W.partitionBy("l_orderkey")
    lines = lines.withColumns({"position": F.when(F.col("l_linenumber") == F.min("l_linenumber").over(whole), 0).otherwise(1), "n": F.count("*").over(whole)}).where("n >= 2")
    loss = S.listwise_loss(lines, "l_orderkey")
    return loss.groupBy("size").agg(F.count("*").alias("groups"), F.round(F.avg("loss"), 6).alias("mean_loss"))


@register(
    "epoch_draws",
    """WITH n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT unnest(range(0, (2500 + n - 1) // n)) AS epoch FROM n),
p AS (SELECT epoch, s_suppkey, row_number() OVER (PARTITION BY epoch ORDER BY md5((20260904 + 1000003 * epoch)::VARCHAR || '|' || s_suppkey), s_suppkey) - 1 AS place FROM supplier CROSS JOIN e)
SELECT (epoch * n + place)::BIGINT AS draw, epoch::BIGINT AS epoch, s_suppkey FROM p, n WHERE epoch * n + place < 2500""",
)
def epoch_draws(spark, sf_dir):
    """D10, D13."""
    return S.epoch_draws(table(spark, sf_dir, "supplier"), "s_suppkey", 2500, 20260904)


@register(
    "converted_groups",
    f"""WITH {GROUPS}, s AS (SELECT *, sha256(query_id || chr(31) || positive_chunk_id || chr(31) || array_to_string(ids, chr(30))) AS source FROM grp)
SELECT query_id, sha256('B|' || source) AS group_id, positive_chunk_id, len(ids)::INT + 1 AS size, md5(positive_text || array_to_string(texts, '|')) AS texts_md5 FROM s""",
)
def converted_groups(spark, sf_dir):
    """D6, D9."""
    c = S.convert_groups(groups(spark, sf_dir), "B", "judge")
    return c.select("query_id", "group_id", F.col("positive.chunk_id").alias("positive_chunk_id"), (F.size("negatives") + 1).alias("size"), F.md5(F.concat(F.col("positive.text"), F.array_join("negatives.text", "|"))).alias("texts_md5"))


@register(
    "collated_pairs",
    f"""WITH {GROUPS}, f AS (SELECT query_id, positive_chunk_id, [positive_text] || texts AS t FROM grp)
SELECT query_id, positive_chunk_id, (i - 1)::INT AS position, (i = 1)::INT AS label, length(t[i])::INT AS length FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM f)""",
)
def collated_pairs(spark, sf_dir):
    """Groups to rows, the positive first."""
    g = groups(spark, sf_dir).withColumn("g", F.struct("query_id", "positive_chunk_id"))
    texts = S.sequence(F.col("positive_text"), F.col("negative_texts"))
    rows = S.collate(g, "g", texts, F.transform(texts, lambda t: F.length(t)), 1_000_000)
    return rows.select("g.query_id", "g.positive_chunk_id", "position", "label", "length")


@register("job_matrix", "SELECT m || '_' || r || '_' || u AS job_id, m AS method, r::INT AS rate, u::INT AS updates FROM (SELECT unnest(['B', 'E']) AS m) CROSS JOIN (SELECT unnest([1, 5]) AS r) CROSS JOIN (SELECT unnest([227, 454, 681]) AS u)")
def job_matrix(spark, sf_dir):
    """D13."""
    j = S.job_matrix(spark, {"method": ["B", "E"], "rate": [1, 5], "updates": [227, 454, 681]})
    return j.select("job_id", "method", *[F.col(c).cast("int").alias(c) for c in ("rate", "updates")])
