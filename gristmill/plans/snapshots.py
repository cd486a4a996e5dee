"""Queries on snapshots and manifests of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import snapshots as S
from gristmill.plans.registry import register, table

#: Tables, their keys and the columns that are hashed.
HASHED = {"orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), "documents": ("doc_id", ["doc_id", "lang", "source", "n_chars"]), "customer": ("c_custkey", ["c_custkey", "c_nationkey", "c_mktsegment"])}
STRINGS = {"o_orderstatus", "o_orderpriority", "lang", "source", "c_mktsegment"}


def _json(columns: list[str]) -> str:
    """The canonical JSON of a row in SQL; the given texts hold nothing to escape."""
    value = lambda c: f"""coalesce('"' || {c} || '"', 'null')""" if c in STRINGS else f"coalesce({c}::VARCHAR, 'null')"
    return "'{' || " + " || ',' || ".join(f"""'"{c}":' || {value(c)}""" for c in sorted(columns)) + " || '}'"


def _digest(h: str) -> str:
    return f"md5(count(*) || '|' || coalesce(bit_xor(('0x' || substr({h}, 1, 15))::BIGINT), 0) || '|' || coalesce(sum(('0x' || substr({h}, 17, 8))::BIGINT), 0))"


def _snapshot(name: str, source: str) -> str:
    key, columns = HASHED[name]
    return f"SELECT '{name}' AS subject, (('0x' || substr(md5({key}::VARCHAR), 1, 4))::INT % {S.PARTS})::INT AS part, count(*)::BIGINT AS rows, {_digest('h')} AS digest FROM (SELECT *, sha256({_json(columns)}) AS h FROM {source}) GROUP BY ALL"


#: After: every 97th document is gone, some orders have another status, customers of part 3 are gone and part 5 alone is doubled.
AFTER = {
    "orders": "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5003 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders)",
    "documents": "(SELECT * FROM documents WHERE doc_id % 97 <> 0)",
    "customer": f"(SELECT * FROM customer WHERE ('0x' || substr(md5(c_custkey::VARCHAR), 1, 4))::INT % {S.PARTS} <> 3 UNION ALL SELECT * FROM customer WHERE ('0x' || substr(md5(c_custkey::VARCHAR), 1, 4))::INT % {S.PARTS} = 5)",
}


def _part(key: str):
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % S.PARTS


def _after(name: str, t: DataFrame) -> DataFrame:
    if name == "orders":
        return t.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5003 == 0, "X").otherwise(F.col("o_orderstatus")))
    if name == "documents":
        return t.where("doc_id % 97 <> 0")
    return t.where(_part("c_custkey") != 3).unionByName(t.where(_part("c_custkey") == 5))


@register(
    "snapshot_changes",
    f"""WITH b AS ({' UNION ALL '.join(_snapshot(n, n) for n in HASHED)}), a AS ({' UNION ALL '.join(_snapshot(n, AFTER[n]) for n in HASHED)})
SELECT coalesce(b.subject, a.subject) AS subject, coalesce(b.part, a.part) AS part, CASE WHEN b.digest IS NULL THEN 'added' WHEN a.digest IS NULL THEN 'lost' ELSE 'changed' END AS status, b.rows AS rows_before, a.rows AS rows_after
FROM b FULL JOIN a ON a.subject = b.subject AND a.part = b.part WHERE b.digest IS NULL OR a.digest IS NULL OR a.digest <> b.digest""",
)
def snapshot_changes(spark, sf_dir):
    """Parts of three tables before and after a change of some of their rows."""
    tables = {n: table(spark, sf_dir, n).select(*c) for n, (_, c) in HASHED.items()}
    both = [reduce(DataFrame.unionByName, [S.table_snapshot(f(n, t), n, HASHED[n][0]) for n, t in tables.items()]) for f in (lambda _, t: t, _after)]
    return S.changes(*both)


STAGES = [("orders", "orders"), ("urgent", "(SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')"), ("documents", "documents")]


def _stage(i: int) -> str:
    name, source = STAGES[i]
    columns = HASHED["documents" if name == "documents" else "orders"][1]
    return f"SELECT '{name}' AS stage, {i} AS position, count(*)::BIGINT AS rows, {_digest('h')} AS digest FROM (SELECT sha256({_json(columns)}) AS h FROM {source})"


_LINK = "sha256({0} || '|' || stage || '|' || rows || '|' || digest)"


@register(
    "manifest_chain",
    f"""WITH s0 AS ({_stage(0)}), s1 AS ({_stage(1)}), s2 AS ({_stage(2)}), c0 AS (SELECT *, {_LINK.format(f"'{S.ORIGIN}'")} AS chain FROM s0),
c1 AS (SELECT s1.*, {_LINK.format('p').replace('stage', 's1.stage').replace('rows', 's1.rows').replace('digest', 's1.digest')} AS chain FROM s1, (SELECT chain AS p FROM c0)),
c2 AS (SELECT s2.*, {_LINK.format('p').replace('stage', 's2.stage').replace('rows', 's2.rows').replace('digest', 's2.digest')} AS chain FROM s2, (SELECT chain AS p FROM c1)) SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2""",
)
def manifest_chain(spark, sf_dir):
    """The manifest of three stages, each link of which holds all before it."""
    return S.chained(_stages(spark, sf_dir))


def _stages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(*HASHED["orders"][1])
    outputs = [orders, orders.where("o_orderpriority = '1-URGENT'"), table(spark, sf_dir, "documents").select(*HASHED["documents"][1])]
    return reduce(DataFrame.unionByName, [S.stage_row(o, name, i) for i, ((name, _), o) in enumerate(zip(STAGES, outputs))])


@register(
    "integrity_suite",
    """SELECT 'documents in full' AS "check", count(*) = count(DISTINCT doc_id) AS passed, (count(*) <> count(DISTINCT doc_id))::BIGINT AS failures, CASE WHEN count(*) <> count(DISTINCT doc_id) THEN count(*) || ' rows, not ' || count(DISTINCT doc_id) END AS example FROM documents
UNION ALL SELECT 'labelled documents exist', count(*) = 0, count(*)::BIGINT, min(l.doc_id::VARCHAR) FROM labels l ANTI JOIN documents d ON l.doc_id = d.doc_id
UNION ALL SELECT 'no order without a customer', count(*) = 0, count(*)::BIGINT, min(o_orderkey::VARCHAR) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'urgent orders are closed', count(*) = 0, count(*)::BIGINT, min(o_orderkey::VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'
UNION ALL SELECT 'public labels', true, 0, NULL
UNION ALL SELECT 'manifest', true, 0, NULL""",
)
def integrity_suite(spark, sf_dir):
    """Counts, lookups, rules, fields and the manifest of the given tables as one report."""
    d, o = table(spark, sf_dir, "documents"), table(spark, sf_dir, "orders")
    labels = table(spark, sf_dir, "labels")
    stages = _stages(spark, sf_dir)
    return S.suite([
        S.count_check("documents in full", d, d.agg(F.countDistinct("doc_id")).first()[0]),
        S.check(spark, "labelled documents exist", labels.join(d, "doc_id", "left_anti"), F.col("doc_id")),
        S.check(spark, "no order without a customer", o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), F.col("o_orderkey")),
        S.check(spark, "urgent orders are closed", o.where("o_orderpriority = '1-URGENT' and o_orderstatus <> 'F'"), F.col("o_orderkey")),
        S.fields_check(spark, "public labels", labels, ("text", "question")),
        S.check(spark, "manifest", S.broken(S.chained(stages), stages), F.col("stage")),
    ])
