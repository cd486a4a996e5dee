"""Queries on rankings of several systems over the same pools.

Systems score the lexical pool by a hash of (instance, query, chunk) plus a share of the evidence grade that grows from U to E; H keeps the fused order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.text import normalize_text, token_f1
from gristmill.operators import diagnostics as D
from gristmill.operators import grading, stats
from gristmill.plans.fragments import norm, norm_tokens
from gristmill.plans.registry import register, table
from gristmill.plans.retrieval import GRADED, graded, ndcg_sql

SHARE = {"H": 0.0, "U": 0.1, "B": 0.2, "E": 0.3}
_VALUES = ", ".join(f"('{i}', '{s}', {seed if seed else 'NULL'}::INT, {SHARE[s]}::DOUBLE)" for i, s, seed in D.instances())
RANKED = f"""{GRADED}, inst AS (SELECT * FROM (VALUES {_VALUES}) v(instance, system, seed, share)),
scored AS (SELECT instance, system, seed, query_id, chunk_id, doc_id, rank AS fused_rank, text, grade, n_relevant,
  CASE WHEN system = 'H' THEN -rank::DOUBLE ELSE round(('0x' || substr(md5(instance || '|' || query_id || '|' || chunk_id), 1, 8))::UBIGINT / 4294967296::DOUBLE + share * grade, 9) END AS score FROM graded CROSS JOIN inst),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY instance, query_id ORDER BY score DESC, fused_rank, chunk_id))::INT AS rank FROM scored)"""
METRICS = f"""{RANKED}, nd4 AS {ndcg_sql('ranked', by='instance, query_id')},
best AS (SELECT instance, query_id, {norm_tokens('text')} AS a FROM ranked WHERE rank = 1), gold AS (SELECT query_id, {norm_tokens('text')} AS b FROM q),
f AS (SELECT instance, query_id, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) AS s, len(a) AS la, len(b) AS lb FROM best JOIN gold USING (query_id)),
metrics AS (SELECT i.instance, i.system, i.seed, nd4.query_id, 'd' || (nd4.query_id % 4) AS domain, round(ndcg, 9) AS ndcg, round(CASE WHEN la = 0 AND lb = 0 THEN 1.0 WHEN la = 0 OR lb = 0 THEN 0.0 ELSE 2 * s::DOUBLE / (la + lb) END::DOUBLE, 9) AS f1,
  v.visibility FROM nd4 JOIN f ON f.instance = nd4.instance AND f.query_id = nd4.query_id JOIN inst i ON i.instance = nd4.instance
  JOIN (SELECT instance, query_id, max((grade = 2)::INT)::DOUBLE AS visibility FROM ranked WHERE rank <= 4 GROUP BY ALL) v ON v.instance = nd4.instance AND v.query_id = nd4.query_id)"""


def ranked(spark, sf_dir):
    """Eight rankings of every pool."""
    g = graded(spark, sf_dir).withColumnRenamed("rank", "fused_rank")
    named = F.array(*[F.struct(F.lit(i).alias("instance"), F.lit(s).alias("system"), F.lit(seed).cast("int").alias("seed"), F.lit(SHARE[s]).alias("share")) for i, s, seed in D.instances()])
    rows = g.withColumn("i", F.explode(named)).select("i.*", *[c for c in g.columns if c != "score"])
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "instance", F.col("query_id").cast("string"), "chunk_id")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    score = F.when(F.col("system") == "H", -F.col("fused_rank").cast("double")).otherwise(F.round(draw + F.col("share") * F.col("grade"), 9))
    return D.rank_systems(rows.withColumn("score", score), ["query_id"])


def metrics(spark, sf_dir):
    """A2-A4 for each ranking: NDCG over the pool, F1 of the first chunk against the item, visibility."""
    r = ranked(spark, sf_dir)
    by = ["instance", "query_id"]
    gold = table(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "text as gold")
    f1 = r.where("rank = 1").join(gold, "query_id").select(*by, F.round(token_f1("text", "gold"), 9).alias("f1"))
    v = r.where("rank <= 4").groupBy("instance", "query_id", "system", "seed").agg(F.max((F.col("grade") == 2).cast("double")).alias("visibility"))
    n = grading.ndcg(r.select(*by, "rank", "grade"), by).withColumn("ndcg", F.round("ndcg", 9))
    return n.join(f1, by).join(v, by).withColumn("domain", F.concat(F.lit("d"), (F.col("query_id") % 4).cast("string")))


@register("system_rankings", f"WITH {RANKED} SELECT instance, query_id, chunk_id, fused_rank, rank, score FROM ranked")
def system_rankings(spark, sf_dir):
    """R14-R19, W1."""
    return ranked(spark, sf_dir).select("instance", "query_id", "chunk_id", "fused_rank", "rank", "score")


@register("ranking_metrics", f"WITH {METRICS} SELECT instance, query_id, domain, ndcg, f1, visibility FROM metrics")
def ranking_metrics(spark, sf_dir):
    """A2, A3, A4."""
    return metrics(spark, sf_dir).select("instance", "query_id", "domain", "ndcg", "f1", "visibility")


@register("group_means", f"WITH {METRICS} SELECT system, coalesce(m.domain, 'all') AS domain, coalesce(m.seed::VARCHAR, 'none') AS seed, count(*)::BIGINT AS n, round(avg(ndcg), 6) AS ndcg, round(avg(f1), 6) AS f1, round(avg(visibility), 6) AS visibility FROM metrics m GROUP BY GROUPING SETS ((system), (m.domain, system), (m.seed, system))")
def group_means(spark, sf_dir):
    """Row-weighted means of all groupings in one expansion."""
    m = metrics(spark, sf_dir)
    s, d, e = F.col("system"), F.col("domain"), F.col("seed")
    g = m.groupingSets([[s], [d, s], [e, s]], s, d, e).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "f1", "visibility")])
    return g.select("system", F.coalesce("domain", F.lit("all")).alias("domain"), F.coalesce(F.col("seed").cast("string"), F.lit("none")).alias("seed"), "n", "ndcg", "f1", "visibility")


@register(
    "top4_overlap",
    f"""WITH {RANKED}, t AS (SELECT system, seed, query_id, list(chunk_id ORDER BY rank) AS top FROM ranked WHERE rank <= 4 AND system IN ('B', 'E') GROUP BY ALL),
o AS (SELECT b.query_id, b.seed, b.top AS b, e.top AS e, len(list_intersect(b.top, e.top)) AS n FROM t b JOIN t e ON b.query_id = e.query_id AND b.seed = e.seed AND b.system = 'B' AND e.system = 'E')
SELECT query_id, seed, n / 4.0::DOUBLE AS intersection_fraction, round(n::DOUBLE / len(list_distinct(b || e)), 9) AS jaccard, b = e AS identical_order, list_sort(b) = list_sort(e) AS identical_set FROM o""",
)
def top4_overlap(spark, sf_dir):
    """Both systems of a seed as columns of one row, by one aggregate instead of a self-join."""
    r = ranked(spark, sf_dir).where("system in ('B', 'E')")
    t = D.top_lists(r, ["query_id", "seed", "system"])
    o = t.groupBy("query_id", "seed").agg(F.max(F.when(F.col("system") == "B", F.col("top"))).alias("b"), F.max(F.when(F.col("system") == "E", F.col("top"))).alias("e"))
    c = D.overlap(F.col("b"), F.col("e"))
    return o.select("query_id", "seed", c["intersection_fraction"].alias("intersection_fraction"), F.round(c["jaccard"], 9).alias("jaccard"), c["identical_order"].alias("identical_order"), c["identical_set"].alias("identical_set"))


@register("pairwise_contrasts", f"""WITH {METRICS}, m AS (SELECT system, avg(ndcg) AS ndcg, avg(f1) AS f1, avg(visibility) AS visibility, list_position(['H', 'U', 'B', 'E'], system) AS p FROM metrics GROUP BY system)
SELECT b.system || ' minus ' || a.system AS contrast, round(b.ndcg - a.ndcg, 6) AS ndcg, round(b.f1 - a.f1, 6) AS f1, round(b.visibility - a.visibility, 6) AS visibility FROM m a JOIN m b ON a.p < b.p""")
def pairwise_contrasts(spark, sf_dir):
    """A19, J8."""
    c = stats.contrasts(metrics(spark, sf_dir), "system", list(D.SYSTEMS), ["ndcg", "f1", "visibility"])
    return c.select("contrast", *[F.round(m, 6).alias(m) for m in ("ndcg", "f1", "visibility")])


ASSOC = """dl AS (SELECT query_id, avg(ndcg) FILTER (system = 'E') - avg(ndcg) FILTER (system = 'B') AS ndcg, avg(f1) FILTER (system = 'E') - avg(f1) FILTER (system = 'B') AS f1, avg(visibility) FILTER (system = 'E') - avg(visibility) FILTER (system = 'B') AS visibility FROM metrics GROUP BY query_id),
lg AS (SELECT query_id, 'ndcg' AS x_name, round(ndcg, 9) AS x, round(f1, 9) AS y FROM dl UNION ALL SELECT query_id, 'visibility', round(visibility, 9), round(f1, 9) FROM dl),
rk AS (SELECT *, rank() OVER (PARTITION BY x_name ORDER BY x) + (count(*) OVER (PARTITION BY x_name, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY x_name ORDER BY y) + (count(*) OVER (PARTITION BY x_name, y) - 1) / 2.0::DOUBLE AS ry FROM lg)"""


@register("associations", f"""WITH {METRICS}, {ASSOC} SELECT x_name, count(*)::BIGINT AS n, round(CASE WHEN min(x) <> max(x) AND min(y) <> max(y) THEN corr(x, y) END, 6) AS pearson, round(CASE WHEN min(x) <> max(x) AND min(y) <> max(y) THEN corr(rx, ry) END, 6) AS spearman FROM rk GROUP BY x_name""")
def associations(spark, sf_dir):
    """Document-level differences of E and B."""
    m = metrics(spark, sf_dir)
    diff = lambda c: F.round(F.avg(F.when(F.col("system") == "E", F.col(c))) - F.avg(F.when(F.col("system") == "B", F.col(c))), 9).alias(c)
    d = m.groupBy("query_id").agg(*[diff(c) for c in ("ndcg", "f1", "visibility")])
    lg = d.select("query_id", F.col("f1").alias("y"), F.expr("stack(2, 'ndcg', ndcg, 'visibility', visibility) as (x_name, x)"))
    return stats.associations(lg, "x", "y", ["x_name"]).select("x_name", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@register("availability", f"""WITH {GRADED}, c AS (SELECT query_id, sum((grade = 2)::INT) AS two, sum((grade >= 1)::INT) AS one FROM graded GROUP BY query_id)
SELECT count(*)::BIGINT AS n_cells, sum((two = 0)::INT)::BIGINT AS zero_grade2, sum((one = 0)::INT)::BIGINT AS zero_grade_ge1 FROM c""")
def availability(spark, sf_dir):
    """A15."""
    return D.availability(graded(spark, sf_dir), ["query_id"])


@register("length_summary", """SELECT lang, count(n_chars)::BIGINT AS n, round(avg(n_chars), 6) AS mean, min(n_chars)::DOUBLE AS min, round(quantile_cont(n_chars, 0.5)::DOUBLE, 6) AS median, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, max(n_chars)::DOUBLE AS max FROM documents GROUP BY lang""")
def length_summary(spark, sf_dir):
    """A13, A20."""
    s = stats.summary(table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("v")), "v", ["lang"])
    return s.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "median", "p95", "max")])


@register(
    "evidence_flow",
    f"""WITH {RANKED}, x AS (SELECT query_id, {norm('text')} AS s FROM q), p AS (SELECT query_id, list({norm('text')} ORDER BY fused_rank) AS pool, list(grade) AS pg FROM ranked WHERE instance = 'H' GROUP BY query_id),
s AS (SELECT instance, query_id, list({norm('text')} ORDER BY rank) AS sel, list(grade) AS sg, {norm("string_agg('[' || rank || '] ' || substr(text, 1, 600), chr(10) || chr(10) ORDER BY rank)")} AS packed FROM ranked WHERE rank <= 4 GROUP BY ALL),
y AS (SELECT instance, query_id, (s <> '')::INT AS annotated, (s <> '' AND len(list_filter(pool, lambda t: contains(t, s))) > 0)::INT AS in_pool, (s <> '' AND len(list_filter(sel, lambda t: contains(t, s))) > 0)::INT AS in_sel, (s <> '' AND contains(packed, s))::INT AS in_packed,
  len(list_filter(sg, lambda g: g = 2))::DOUBLE / nullif(len(list_filter(pg, lambda g: g = 2)), 0) AS recall FROM s JOIN p USING (query_id) JOIN x USING (query_id))
SELECT instance, query_id, annotated AS annotated_spans, in_pool AS pool_spans, in_sel AS selected_spans, in_packed AS packed_spans, (in_sel = 1 AND in_packed = 0)::INT AS lost_in_packing, round(recall, 6) AS grade2_recall FROM y""",
)
def evidence_flow(spark, sf_dir):
    """Contexts are packed as `[i]` and the chunk's first 600 characters."""
    r = ranked(spark, sf_dir).withColumn("n", normalize_text("text"))
    in_order = lambda by, c: F.transform(F.sort_array(F.collect_list(F.struct(by, c))), lambda x: x[c])
    pool = r.where("instance = 'H'").groupBy("query_id").agg(in_order("fused_rank", "n").alias("pool"), F.collect_list("grade").alias("pool_grades"))
    context = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, 600))
    sel = r.where("rank <= 4").withColumn("c", context).groupBy("instance", "query_id").agg(in_order("rank", "n").alias("selected"), F.collect_list("grade").alias("selected_grades"), F.array_join(in_order("rank", "c"), "\n\n").alias("context"))
    spans = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), D.spans_of(F.array("text")).alias("spans"))
    rows = sel.join(pool, "query_id").join(spans, "query_id").withColumn("packed", normalize_text("context"))
    flow = D.evidence_flow(*[F.col(c) for c in ("spans", "pool", "selected", "packed", "pool_grades", "selected_grades")])
    return rows.select("instance", "query_id", *[c.alias(name) for name, c in flow.items() if name != "grade2_recall"], F.round(flow["grade2_recall"], 6).alias("grade2_recall"))


@register("correction_aggregates", f"""WITH {RANKED}, a AS {ndcg_sql('ranked', by='instance, query_id')}, b AS {ndcg_sql('(SELECT * FROM ranked WHERE rank <= 4)', by='instance, query_id')},
c AS (SELECT i.system, a.ndcg AS corrected, b.ndcg AS legacy FROM a JOIN b USING (instance, query_id) JOIN inst i USING (instance))
SELECT system, count(*)::BIGINT AS records, round(avg(legacy), 6) AS legacy, round(avg(corrected), 6) AS corrected, round(avg(corrected - legacy), 6) AS delta FROM c GROUP BY system""")
def correction_aggregates(spark, sf_dir):
    """A21, A22."""
    r = ranked(spark, sf_dir).select("instance", "system", "query_id", "rank", "grade")
    by = ["system", "instance", "query_id"]
    both = grading.ndcg(r, by).join(grading.ndcg(r, by, pool=False).withColumnRenamed("ndcg", "legacy"), by)
    return both.groupBy("system").agg(F.count("*").alias("records"), F.round(F.avg("legacy"), 6).alias("legacy"), F.round(F.avg("ndcg"), 6).alias("corrected"), F.round(F.avg(F.col("ndcg") - F.col("legacy")), 6).alias("delta"))


@register(
    "correction_order",
    f"""WITH {RANKED}, a AS {ndcg_sql('ranked', by='instance, query_id')}, b AS {ndcg_sql('(SELECT * FROM ranked WHERE rank <= 4)', by='instance, query_id')},
m AS (SELECT 'd' || (a.query_id % 4) AS domain, i.system, round(avg(b.ndcg), 9) AS legacy, round(avg(a.ndcg), 9) AS corrected FROM a JOIN b USING (instance, query_id) JOIN inst i USING (instance) GROUP BY ALL),
o AS (SELECT domain, string_agg(system, '>' ORDER BY legacy DESC, system) AS by_legacy, string_agg(system, '>' ORDER BY corrected DESC, system) AS by_corrected FROM m GROUP BY domain)
SELECT *, by_legacy <> by_corrected AS changed FROM o""",
)
def correction_order(spark, sf_dir):
    """Whether the correction changes the order of the systems, by domain."""
    r = ranked(spark, sf_dir).select("instance", "system", "query_id", "rank", "grade")
    by = ["system", "instance", "query_id"]
    both = grading.ndcg(r, by).withColumnRenamed("ndcg", "corrected").join(grading.ndcg(r, by, pool=False).withColumnRenamed("ndcg", "legacy"), by)
    o = D.ordering(both.withColumn("domain", F.concat(F.lit("d"), (F.col("query_id") % 4).cast("string"))), ["domain"], "system", ["legacy", "corrected"])
    return o.select("domain", F.array_join("by_legacy", ">").alias("by_legacy"), F.array_join("by_corrected", ">").alias("by_corrected"), "changed")
