"""Queries on clustered statistics and selections.

Documents are orders, their value the mean of discount less tax of their lines; families are customers, domains order priorities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import stats
from gristmill.plans.registry import register, table

DOCS = "d AS (SELECT l_orderkey AS doc, o_custkey AS family, o_orderpriority AS domain, avg(l_discount - l_tax) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
SEED = 20260923
#: The reference's numbers of draws.
SIGN_FLIPS, BOOTSTRAPS = 100_000, 20_000


def docs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_tax").groupBy(F.col("l_orderkey").alias("doc")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("v"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("family"), F.col("o_orderpriority").alias("domain"))
    return lines.join(o, "doc")


def _keys(unit: str) -> str:
    return f"('0x' || substr(md5('{SEED}|' || {unit}), 1, 8))::UBIGINT AS k1, ('0x' || substr(md5('{SEED}|' || {unit}), 9, 8))::UBIGINT AS k2"


def _mixed(rows: str, draw: str, keep: str) -> str:
    """Rows with h, the number of (k1, k2) and the draw: each step is a level, so that DuckDB computes it once."""
    level = f"SELECT {keep}, k2, (k1 + {draw}::UBIGINT * 2654435769::UBIGINT) % 4294967296::UBIGINT AS h FROM {rows}"
    for again in (True, False):
        level = f"SELECT {keep}, k2, xor(h, h >> 16) * 2246822507::UBIGINT % 4294967296::UBIGINT AS h FROM ({level})"
        level = f"SELECT {keep}, k2, xor(h, h >> 13) * 3266489909::UBIGINT % 4294967296::UBIGINT AS h FROM ({level})"
        level = f"SELECT {keep}, k2, {'xor(xor(h, h >> 16), k2)' if again else 'xor(h, h >> 16)'} AS h FROM ({level})"
    return f"({level})"


WORDS = f"(SELECT s, k1, k2, w FROM (SELECT s, {_keys('family')} FROM f) CROSS JOIN (SELECT unnest(range({-(-SIGN_FLIPS // 32)})) AS w))"


@register(
    "sign_flip_p",
    f"""WITH {DOCS}, f AS (SELECT family, sum(v) AS s, count(*) AS n FROM d GROUP BY family), t AS (SELECT sum(s) AS total, sum(n) AS docs FROM f),
x AS (SELECT w * 32 + b AS draw, sum(CASE WHEN (h >> b::UBIGINT) & 1 = 0 THEN s ELSE -s END) AS t FROM {_mixed(WORDS, 'w', 's, w')} CROSS JOIN (SELECT unnest(range(32)) AS b) WHERE w * 32 + b < {SIGN_FLIPS} GROUP BY 1)
SELECT round(max(total / docs), 9) AS observed, count(*)::BIGINT AS draws, round((1 + sum((abs(round(t, 9)) >= abs(round(total, 9)))::INT)) / (count(*) + 1)::DOUBLE, 9) AS p FROM x, t""",
)
def sign_flip_p(spark, sf_dir):
    """A27."""
    p = stats.sign_flip_p(docs(spark, sf_dir), "v", "family", SIGN_FLIPS, SEED)
    return p.select(F.round("observed", 9).alias("observed"), "draws", F.round("p", 9).alias("p"))


SLOTS = f"(SELECT domain, size, draw, k1, k2 FROM (SELECT domain, size, {_keys('domain || chr(58) || i')} FROM f) CROSS JOIN (SELECT unnest(range({BOOTSTRAPS})) AS draw))"
BOOT = f"""{DOCS}, f AS (SELECT domain, family, sum(v) AS s, count(*) AS n, row_number() OVER (PARTITION BY domain ORDER BY md5(family::VARCHAR), family) - 1 AS i, count(*) OVER (PARTITION BY domain) AS size FROM d GROUP BY domain, family),
x AS (SELECT draw, domain, h % size::UBIGINT AS i FROM {_mixed(SLOTS, 'draw', 'domain, size, draw')}),
b AS (SELECT draw, sum(s) / sum(n) AS mean FROM x JOIN f USING (domain, i) GROUP BY draw)"""


@register("cluster_bootstrap_ci", f"WITH {BOOT} SELECT round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM b")
def cluster_bootstrap_ci(spark, sf_dir):
    """A26, A28."""
    b = stats.bootstrap(docs(spark, sf_dir), "v", "family", "domain", BOOTSTRAPS, SEED)
    return stats.interval(b).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@register(
    "primary_summary",
    f"""WITH {DOCS}, g AS (SELECT domain, avg(v) AS effect, count(*) AS n FROM d GROUP BY domain), o AS (SELECT avg(v) AS estimate, count(*) AS documents, count(DISTINCT family) AS families FROM d)
SELECT domain, n::BIGINT AS documents_in_domain, round(effect, 9) AS domain_effect, round(estimate, 9) AS estimate, documents::BIGINT AS documents, families::BIGINT AS families,
  round((SELECT avg(effect) FROM g), 9) AS equal_domain_mean, estimate >= 0.010 AS large_enough FROM g, o""",
)
def primary_summary(spark, sf_dir):
    """The estimate, by domain and with domains weighing alike; families are counted after a sum by family."""
    d = docs(spark, sf_dir)
    g = d.groupBy("domain").agg(F.avg("v").alias("effect"), F.count("*").alias("n"))
    o = d.groupBy("family").agg(F.sum("v").alias("s"), F.count("*").alias("n")).agg((F.sum("s") / F.sum("n")).alias("estimate"), F.sum("n").alias("documents"), F.count("*").alias("families"))
    e = g.agg(F.round(F.avg("effect"), 9).alias("equal_domain_mean"))
    both = g.crossJoin(F.broadcast(o)).crossJoin(F.broadcast(e))
    return both.select("domain", F.col("n").alias("documents_in_domain"), F.round("effect", 9).alias("domain_effect"), F.round("estimate", 9).alias("estimate"), "documents", "families", "equal_domain_mean", (F.col("estimate") >= 0.010).alias("large_enough"))


#: Rows of a paired experiment: system by return flag (A is B, N is E), seed by line number, chunker by ship month's quarter.
EXP = """e AS (SELECT l_suppkey AS doc, (l_linenumber % 3)::INT AS seed, 'c' || quarter(l_shipdate) AS chunker, CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'N' THEN 'E' END AS system, l_discount AS v FROM lineitem WHERE l_returnflag IN ('A', 'N')),
c AS (SELECT doc, chunker, seed, avg(v) FILTER (system = 'E') AS y, avg(v) FILTER (system = 'B') AS x FROM e GROUP BY doc, chunker, seed),
pd AS (SELECT doc, seed, avg(y - x) AS difference FROM c WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY doc, seed)"""


def experiment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "N"))
    return li.select(F.col("l_suppkey").alias("doc"), (F.col("l_linenumber") % 3).cast("int").alias("seed"), F.concat(F.lit("c"), F.quarter("l_shipdate").cast("string")).alias("chunker"), F.when(F.col("l_returnflag") == "A", "B").otherwise("E").alias("system"), F.col("l_discount").alias("v"))


def differences(spark, sf_dir):
    return stats.paired_differences(experiment(spark, sf_dir), "doc", "chunker", "system", "seed", "v")


@register("document_diffs", f"WITH {EXP} SELECT doc, seed, round(difference, 9) AS difference FROM pd")
def document_diffs(spark, sf_dir):
    """A6, J2."""
    return differences(spark, sf_dir).select("doc", "seed", F.round("difference", 9).alias("difference"))


@register(
    "seed_leave_one_out",
    f"""WITH {EXP}, s AS (SELECT seed, avg(difference) AS effect FROM pd GROUP BY seed), t AS (SELECT sum(effect) AS total, count(*) AS n, stddev_samp(effect) AS sd, min(effect) AS lo, max(effect) AS hi FROM s)
SELECT seed, round(effect, 9) AS effect, round((total - effect) / nullif(n - 1, 0), 9) AS without, round(sd, 9) AS seed_sd, round(lo, 9) AS seed_min, round(hi, 9) AS seed_max FROM s, t""",
)
def seed_leave_one_out(spark, sf_dir):
    """A7."""
    s = differences(spark, sf_dir).groupBy("seed").agg(F.avg("difference").alias("effect"))
    sd = s.agg(F.stddev_samp("effect").alias("seed_sd"), F.min("effect").alias("seed_min"), F.max("effect").alias("seed_max"))
    r = stats.leave_one_out(s).crossJoin(F.broadcast(sd))
    return r.select("seed", *[F.round(c, 9).alias(c) for c in ("effect", "without", "seed_sd", "seed_min", "seed_max")])


@register(
    "system_means",
    f"""WITH {EXP} SELECT system, coalesce(e.chunker, 'all') AS chunker, coalesce(e.seed::VARCHAR, 'all') AS seed, count(*)::BIGINT AS n, round(avg(v), 9) AS mean FROM e GROUP BY GROUPING SETS ((system), (system, e.chunker), (system, e.seed), (system, e.chunker, e.seed))""",
)
def system_means(spark, sf_dir):
    """One expansion for all groupings."""
    e = experiment(spark, sf_dir)
    g = e.groupingSets([[F.col("system")], [F.col("system"), F.col("chunker")], [F.col("system"), F.col("seed")], [F.col("system"), F.col("chunker"), F.col("seed")]], F.col("system"), F.col("chunker"), F.col("seed"))
    g = g.agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"))
    return g.select("system", F.coalesce("chunker", F.lit("all")).alias("chunker"), F.coalesce(F.col("seed").cast("string"), F.lit("all")).alias("seed"), "n", "mean")


#: A grid of two methods, learning rates and update budgets from order rows.
GRID = """g AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'E' END AS method, CASE o_orderpriority WHEN '1-URGENT' THEN 1e-5 WHEN '2-HIGH' THEN 5e-5 ELSE 1e-4 END::DOUBLE AS lr,
  CASE o_orderstatus WHEN 'F' THEN 227 WHEN 'O' THEN 454 ELSE 681 END::INT AS updates, avg(o_totalprice) / 1e6 AS metric FROM orders GROUP BY ALL)"""


def grid(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lr = F.when(F.col("o_orderpriority") == "1-URGENT", 1e-5).when(F.col("o_orderpriority") == "2-HIGH", 5e-5).otherwise(1e-4)
    updates = F.when(F.col("o_orderstatus") == "F", 227).when(F.col("o_orderstatus") == "O", 454).otherwise(681)
    return o.groupBy(F.when(F.col("o_orderkey") % 2 == 0, "B").otherwise("E").alias("method"), lr.alias("lr"), updates.alias("updates")).agg((F.avg("o_totalprice") / 1e6).alias("metric"))


@register(
    "select_shared_config",
    f"""WITH {GRID}, s AS (SELECT lr, updates, avg(metric) FILTER (method = 'B') AS b, avg(metric) FILTER (method = 'E') AS e FROM g GROUP BY ALL),
m AS (SELECT *, (b + e) / 2 AS shared FROM s WHERE b IS NOT NULL AND e IS NOT NULL) SELECT lr, updates, round(shared, 9) AS shared_mean FROM m ORDER BY round(shared, 9) DESC, updates, lr LIMIT 1""",
)
def select_shared_config(spark, sf_dir):
    """The mean of both methods; ties to fewer updates, then the lower rate."""
    g = grid(spark, sf_dir).groupBy("lr", "updates").agg(F.avg(F.when(F.col("method") == "B", F.col("metric"))).alias("b"), F.avg(F.when(F.col("method") == "E", F.col("metric"))).alias("e")).where("b is not null and e is not null")
    return stats.argbest(g.withColumn("shared_mean", (F.col("b") + F.col("e")) / 2), "shared_mean", [F.col("updates"), F.col("lr")]).select("lr", "updates", F.round("shared_mean", 9).alias("shared_mean"))


@register("grid_select", f"WITH {GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(metric, 9) DESC, updates, lr) AS k FROM g) SELECT method, lr, updates, round(metric, 9) AS metric FROM r WHERE k = 1")
def grid_select(spark, sf_dir):
    """A10: the best cell of each method, by one aggregate over an ordered struct."""
    order = F.struct((-F.round("metric", 9)).alias("m"), "updates", "lr")
    return grid(spark, sf_dir).groupBy("method").agg(F.min(order).alias("o"), F.min_by("metric", order).alias("metric")).select("method", "o.lr", "o.updates", F.round("metric", 9).alias("metric"))


@register(
    "select_comparator",
    f"""WITH {EXP}, q AS (SELECT doc, 's' || seed AS base, avg(v) AS m FROM e GROUP BY ALL), b AS (SELECT base, avg(m) AS mean FROM q GROUP BY base)
SELECT base AS selected, round(mean, 9) AS mean FROM b ORDER BY round(mean, 9) DESC, list_position(['s2', 's0', 's1'], base) LIMIT 1""",
)
def select_comparator(spark, sf_dir):
    """Question means first; ties in a stated order."""
    q = experiment(spark, sf_dir).groupBy("doc", F.concat(F.lit("s"), F.col("seed").cast("string")).alias("selected")).agg(F.avg("v").alias("m"))
    b = q.groupBy("selected").agg(F.avg("m").alias("mean"))
    return stats.argbest(b, "mean", [F.array_position(F.array(F.lit("s2"), F.lit("s0"), F.lit("s1")), F.col("selected"))]).select("selected", F.round("mean", 9).alias("mean"))


@register(
    "confirmatory_summary",
    f"""WITH {EXP}, q AS (SELECT doc, avg(y) AS e, avg(x) AS b FROM c WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY doc)
SELECT count(*)::BIGINT AS questions, round(avg(b), 9) AS comparator, round(avg(e), 9) AS evidence_aware, round(avg(e - b), 9) AS mean_difference, avg(e - b) >= 0.01 AS passes_effect FROM q""",
)
def confirmatory_summary(spark, sf_dir):
    """Condition means within a question, then over questions."""
    e = experiment(spark, sf_dir)
    c = e.groupBy("doc", "chunker", "seed").agg(F.avg(F.when(F.col("system") == "E", F.col("v"))).alias("y"), F.avg(F.when(F.col("system") == "B", F.col("v"))).alias("x")).where("x is not null and y is not null")
    q = c.groupBy("doc").agg(F.avg("y").alias("e"), F.avg("x").alias("b"))
    return q.agg(F.count("*").alias("questions"), F.round(F.avg("b"), 9).alias("comparator"), F.round(F.avg("e"), 9).alias("evidence_aware"), F.round(F.avg(F.col("e") - F.col("b")), 9).alias("mean_difference"), (F.avg(F.col("e") - F.col("b")) >= 0.01).alias("passes_effect"))
