"""Queries on retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import grading, retrieval
from gristmill.functions.text import normalize_text
from gristmill.plans.fragments import F128, QUERIES, RELEVANT, bm25_cte, documents, fixed_128, lexical, norm, queries, shared
from gristmill.plans.registry import register, table

POOL, TOP = 20, 4
BM25 = bm25_cte("q", "chunks_fixed_128", POOL)
DENSE = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_inner_product(a.v, b.v), 6) AS score FROM e a CROSS JOIN e b WHERE a.vec_id % 50 = 0),
dense AS (SELECT * FROM (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank, score FROM s) WHERE rank <= 20)"""


def dense_lists(spark, sf_dir):
    """The stated queries are the vectors whose id is divisible by 50; scores to 6 digits, as float32 products are."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    d = retrieval.dense(q, e.selectExpr("vec_id as chunk_id", "embedding as vector"), 2 * POOL)
    return retrieval.ranked(d.withColumn("score", F.round("score", 6)), POOL).select("query_id", "chunk_id", "rank", "score")


def bm25_lists(spark, sf_dir):
    return shared(spark, sf_dir, "bm25", lambda: retrieval.bm25(queries(spark, sf_dir), fixed_128(spark, sf_dir), POOL))


def with_texts(spark, sf_dir, pool):
    """The lexical pool with its chunks; it goes out to the chunks, which are not shuffled."""
    few = retrieval.small(pool, queries(spark, sf_dir), retrieval.SMALL // POOL)
    return fixed_128(spark, sf_dir).select("chunk_id", "doc_id", "text").join(few, "chunk_id")


def relevant(spark, sf_dir):
    return shared(spark, sf_dir, "relevant", lambda: _relevant(spark, sf_dir))


def _relevant(spark, sf_dir):
    """(query_id, doc_id): documents that hold the query's item whole."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), normalize_text("text").alias("n"))
    return grading.containment(d, queries(spark, sf_dir).select("query_id", normalize_text("text").alias("n")), "doc_id", "query_id")


def graded(spark, sf_dir):
    return shared(spark, sf_dir, "graded", lambda: _graded(spark, sf_dir))


def _graded(spark, sf_dir):
    """(query_id, chunk_id, doc_id, rank, score, text, grade, n_relevant): the lexical pool with its grades."""
    pool = with_texts(spark, sf_dir, bm25_lists(spark, sf_dir))
    q = queries(spark, sf_dir).select("query_id", normalize_text("text").alias("span"))
    rel = relevant(spark, sf_dir)
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    rows = pool.join(q, "query_id").join(rel.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left").join(n, "query_id", "left")
    grade = F.when((F.col("span") != "") & F.contains(normalize_text("text"), F.col("span")), 2).when(F.col("hit"), 1).otherwise(0)
    return rows.select("query_id", "chunk_id", "doc_id", "rank", "score", "text", grade.alias("grade"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


GRADED = f"""{QUERIES}, {F128}, {BM25}, {RELEVANT},
graded AS (SELECT b.query_id, b.chunk_id, c.doc_id, b.rank, b.score, c.text,
  CASE WHEN x.n <> '' AND contains({norm('c.text')}, x.n) THEN 2 WHEN rel.doc_id IS NOT NULL THEN 1 ELSE 0 END::INT AS grade,
  coalesce(k.n, 0) AS n_relevant
  FROM bm25 b JOIN chunks_fixed_128 c ON b.chunk_id = c.chunk_id JOIN (SELECT query_id, {norm('text')} AS n FROM q) x ON x.query_id = b.query_id
  LEFT JOIN rel ON rel.query_id = b.query_id AND rel.doc_id = c.doc_id LEFT JOIN (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id) k ON k.query_id = b.query_id)"""


def ndcg_sql(rows: str, k: int = 4, by: str = "query_id") -> str:
    return f"""(SELECT {by}, CASE WHEN idcg = 0 THEN 0.0 ELSE dcg / idcg END AS ndcg FROM (SELECT {by},
  sum(CASE WHEN rank <= {k} THEN (pow(2.0::DOUBLE, grade) - 1) / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg, sum(CASE WHEN ir <= {k} THEN (pow(2.0::DOUBLE, grade) - 1) / log2(ir + 1.0::DOUBLE) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY grade DESC, rank) AS ir FROM {rows}) GROUP BY {by}))"""


@register("flagship_bm25_ndcg", f"WITH {GRADED} SELECT query_id, round(ndcg, 6) AS ndcg_at_4 FROM {ndcg_sql('graded')}")
def flagship_bm25_ndcg(spark, sf_dir):
    """Items against fixed chunks of all documents: BM25 top 20, substring grades, NDCG at 4."""
    return grading.ndcg(graded(spark, sf_dir).select("query_id", "rank", "grade"), ["query_id"], TOP).select("query_id", F.round("ndcg", 6).alias("ndcg_at_4"))


@register("bm25_topk", f"WITH {QUERIES}, {F128}, {BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25")
def bm25_topk(spark, sf_dir):
    """R2, R3, O1."""
    return bm25_lists(spark, sf_dir).withColumn("score", F.round("score", 6))


@register("dense_topk", f"WITH {DENSE} SELECT * FROM dense")
def dense_topk(spark, sf_dir):
    """R4, R5."""
    return dense_lists(spark, sf_dir)


HASHED = """tb AS (SELECT chunk_id, t, count(*)::DOUBLE AS n FROM (SELECT chunk_id, unnest(t) AS t FROM tok) GROUP BY ALL)"""


@register("vector_norms", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x * (1 + vec_id % 3)) AS v FROM v)
SELECT vec_id, label, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 6) AS unit_sum FROM n""")
def vector_norms(spark, sf_dir):
    """Vectors of other lengths brought to unit length."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("v"))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    e = e.withColumn("u", retrieval.normalised("v"))
    return e.select("vec_id", "label", F.round(F.sqrt(total(F.col("v"), lambda x: x * x)), 6).alias("norm"), F.round(total(F.col("u"), lambda x: x), 6).alias("unit_sum"))


@register("rrf_fusion", f"""WITH {DENSE}, back AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id))::INT AS rank FROM dense),
p AS (SELECT query_id, chunk_id, 0 AS l, rank, 0.6::DOUBLE / (60 + rank) AS s FROM dense UNION ALL SELECT query_id, chunk_id, 1, rank, 0.4::DOUBLE / (60 + rank) FROM back WHERE rank <= 10),
f AS (SELECT query_id, chunk_id, round(sum(s), 9) AS score, min(l * 1000 + rank) AS seen FROM p GROUP BY ALL)
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen))::INT AS rank, score FROM f QUALIFY rank <= 20""")
def rrf_fusion(spark, sf_dir):
    """The dense list fused with the ten last of it in reverse, so that lists overlap in part and in other order."""
    from pyspark.sql import Window as W

    d = dense_lists(spark, sf_dir)
    back = d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "chunk_id"))).where("rank <= 10")
    return retrieval.fuse([(d, retrieval.DENSE_WEIGHT), (back, retrieval.LEXICAL_WEIGHT)], POOL)


@register("hybrid_pool")
def hybrid_pool(spark, sf_dir):
    """Dense (stand-in encoder) and lexical lists fused; held against plain Python in the tests."""
    return retrieval.hybrid(queries(spark, sf_dir), fixed_128(spark, sf_dir), POOL)


@register("pool_hash", f"""WITH {GRADED} SELECT query_id, sha256(string_agg(rank || chr(31) || chunk_id || chr(31) || doc_id || chr(31) || sha256(text), chr(10) ORDER BY rank)) AS pool_sha256, count(*)::BIGINT AS candidate_count FROM graded GROUP BY query_id""")
def pool_hash(spark, sf_dir):
    """R12, R13."""
    return retrieval.pool_hash(graded(spark, sf_dir))


@register("rerank_lexical", f"""WITH {QUERIES}, {F128}, {BM25},
x AS (SELECT b.query_id, b.chunk_id, b.rank AS fused_rank, round(coalesce(len(list_intersect(qt, list_distinct(ct)))::DOUBLE / nullif(len(qt), 0), 0), 9) AS score
  FROM bm25 b JOIN (SELECT query_id, list_distinct({lexical('text')}) AS qt FROM q) USING (query_id) JOIN (SELECT chunk_id, {lexical('text')} AS ct FROM chunks_fixed_128) USING (chunk_id))
SELECT query_id, chunk_id, fused_rank, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank, chunk_id))::INT AS rank, score FROM x QUALIFY rank <= 4""")
def rerank_lexical(spark, sf_dir):
    """Only the pool meets the scorer."""
    return retrieval.rerank(bm25_lists(spark, sf_dir), queries(spark, sf_dir), fixed_128(spark, sf_dir), TOP)


def overlap_model():
    """A stand-in for the pair model: the yes logit is the share of a prompt's ids that occur in it before, the no logit 0.5."""
    import numpy as np

    def logits(ids, mask):
        out = np.zeros((*ids.shape, 2))
        for row, (own, held) in enumerate(zip(ids, mask)):
            real = own[held.astype(bool)]
            out[row, -1] = 0.5, 1 - len(set(real.tolist())) / len(real)
        return out

    return logits


@register("pair_scores")
def pair_scores(spark, sf_dir):
    """The lexical pool scored by a stand-in model in batches by length; held against single pairs in the tests."""
    from gristmill.operators.pairs import score_pairs
    from gristmill.plans.chunks import tokenizer

    pool = bm25_lists(spark, sf_dir).select("query_id", "chunk_id", "rank")
    rows = with_texts(spark, sf_dir, pool).join(queries(spark, sf_dir).select("query_id", F.col("text").alias("query_text")), "query_id")
    scored, _ = score_pairs(rows, ["query_id", "chunk_id", "rank"], F.col("query_text"), F.col("text"), F.lit("Tell whether the document answers the query."), tokenizer(), overlap_model, 1, 0)
    return scored.select("query_id", "chunk_id", "rank", "n_tokens", F.round("score_margin", 9).alias("score_margin"), F.round("score_probability", 9).alias("score_probability"))
