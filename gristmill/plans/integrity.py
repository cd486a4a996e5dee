"""Queries on integrity, stores and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import integrity as I
from gristmill.sources import inventory, jsonl
from gristmill.streaming import ledger
from gristmill.plans.registry import register, table


@register("matrix_missing", """WITH d AS (SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem)
SELECT a.l_suppkey, b.l_linenumber, c.l_returnflag FROM (SELECT DISTINCT l_suppkey FROM d) a CROSS JOIN (SELECT DISTINCT l_linenumber FROM d) b CROSS JOIN (SELECT DISTINCT l_returnflag FROM d) c
EXCEPT SELECT * FROM d""")
def matrix_missing(spark, sf_dir):
    """J6, J7, U2."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag").distinct()
    return I.missing_cells(li, ["l_suppkey", "l_linenumber", "l_returnflag"])


CANON = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'"""


def hashed_orders(spark, sf_dir):
    return jsonl.with_hash(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))


@register("row_hashes", f"SELECT o_orderkey, sha256({CANON}) AS row_sha256 FROM orders")
def row_hashes(spark, sf_dir):
    """S2, S3."""
    return hashed_orders(spark, sf_dir).select("o_orderkey", "row_sha256")


@register("keyed_upsert_conflicts", """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'append' WHEN o_orderkey % 7 = 0 AND o_orderstatus <> 'X' THEN 'conflict' ELSE 'skip' END AS status, count(*)::BIGINT AS rows FROM orders GROUP BY 1""")
def keyed_upsert_conflicts(spark, sf_dir):
    """Stored are the orders whose key isn't divisible by 3; new ones have another status where the key is divisible by 7."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    stored = jsonl.with_hash(o.where("o_orderkey % 3 <> 0"))
    new = jsonl.with_hash(o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return jsonl.classify_append(stored, new, ["o_orderkey"]).groupBy("status").agg(F.count("*").alias("rows"))


@register("pending_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def pending_anti_join(spark, sf_dir):
    """J4, T3."""
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return I.pending(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), done, ["c_custkey"])


@register("allowed_semi_join", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def allowed_semi_join(spark, sf_dir):
    """J5."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@register("lookup_attach", """SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality, coalesce(l.toxic, -1)::INT AS toxic, CASE WHEN l.doc_id IS NULL THEN NULL ELSE md5(d.doc_id || ':' || l.quality) END AS label_md5 FROM documents d LEFT JOIN labels l USING (doc_id)""")
def lookup_attach(spark, sf_dir):
    """J1, J11."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return d.select("doc_id", *[F.coalesce(c, F.lit(-1)).cast("int").alias(c) for c in ("quality", "toxic")], F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("quality").cast("string"))).alias("label_md5"))


@register("copy_consistency", """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE coalesce(n, 0) END AS n FROM customer LEFT JOIN a ON c_custkey = k)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left only' WHEN a.k IS NULL THEN 'right only' ELSE 'differs' END AS problem FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n IS DISTINCT FROM b.n""")
def copy_consistency(spark, sf_dir):
    """Order counts against a copy by customer in which every fifth count is 0."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(a, "k", "left").select("k", F.when(F.col("k") % 5 == 0, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    return I.inconsistent(a, b, ["k"], ["n"])


SESSIONS = """s AS (SELECT user_id, date_trunc('day', ts) AS day, min(ts) AS started, max(ts) AS heartbeat, CASE WHEN arg_max(event_type, (ts, event_id)) = (SELECT min(event_type) FROM events) THEN NULL ELSE max(ts) END AS ended FROM events GROUP BY ALL),
a AS (SELECT *, greatest(0, (epoch_us(coalesce(ended, heartbeat + INTERVAL 60 SECOND)) - epoch_us(started)) / 1e6::DOUBLE) AS allocated FROM s)"""


def sessions(spark, sf_dir):
    """A session for each user and day; it never ended where its last event is of the first type."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    first = e.agg(F.min("event_type").alias("first"))
    s = e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.min("ts").alias("started"), F.max("ts").alias("heartbeat"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return s.crossJoin(F.broadcast(first)).withColumn("ended", F.when(F.col("last") != F.col("first"), F.col("heartbeat")))


@register("ledger_budget", f"""WITH {SESSIONS}, c AS (SELECT *, sum(round(allocated * 1e6)::BIGINT) OVER (PARTITION BY user_id ORDER BY day) / 1e6::DOUBLE AS cum FROM a)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(allocated, 3) AS allocated_seconds, ended IS NULL AS recovered, round(cum, 3) AS cumulative_seconds, round(greatest(0, 40000 - cum), 3) AS remaining_seconds, cum > 40000 AS over FROM c""")
def ledger_budget(spark, sf_dir):
    """T1, W8."""
    c = ledger.cumulative(ledger.allocated(sessions(spark, sf_dir)), ["user_id"], ["day"], 40000.0)
    return c.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("allocated_seconds", 3).alias("allocated_seconds"), "recovered", F.round("cumulative_seconds", 3).alias("cumulative_seconds"), F.round("remaining_seconds", 3).alias("remaining_seconds"), "over")


@register("event_sessions", """SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round((epoch_us(coalesce(ended, heartbeat + INTERVAL 60 SECOND)) - epoch_us(started)) / 1e6::DOUBLE, 3) AS allocated_seconds, ended IS NULL AS recovered
FROM (SELECT user_id, date_trunc('day', ts) AS day, min(ts) AS started, max(ts) AS heartbeat, max(CASE WHEN event_id % 7 = 0 THEN ts END) AS ended FROM events GROUP BY ALL)""")
def event_sessions(spark, sf_dir):
    """Sessions by user and day from an event log in which every seventh event is an end."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), "ts", F.when(F.col("event_id") % 7 == 0, "end").otherwise("beat").alias("event"))
    a = ledger.allocated(ledger.sessions_of(e, ["user_id", "day"], "ts"))
    return a.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("allocated_seconds", 3).alias("allocated_seconds"), "recovered")


@register("moving_rate", """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS recent FROM events""")
def moving_rate(spark, sf_dir):
    """W7."""
    return ledger.moving_rate(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("recent", 6).alias("recent"))


@register("utc_text", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events""")
def utc_text(spark, sf_dir):
    """To text and back."""
    e = table(spark, sf_dir, "events").select("event_id", ledger.utc_text(F.col("ts")).alias("utc"))
    return e.select("event_id", "utc", F.unix_timestamp(ledger.from_utc_text(F.col("utc"))).alias("seconds"))


@register("report_lines", r"""SELECT doc_id, i::INT AS line_number, md5(line) AS line_md5, CASE WHEN source = 'src0' THEN 'known' ELSE 'to check' END AS classification FROM
(SELECT doc_id, source, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents)) WHERE regexp_matches(line, '(?i)licen[sc]ed|all rights reserved')""")
def report_lines(spark, sf_dir):
    """P22."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    r = inventory.scan_lines(d, "text", "(?i)licen[sc]ed|all rights reserved")
    return r.select("doc_id", "line_number", F.md5("line").alias("line_md5"), F.when(F.col("source") == "src0", "known").otherwise("to check").alias("classification"))


@register("stable_join_key", """SELECT DISTINCT sha256('["' || l_suppkey || '","' || l_returnflag || '","' || l_linestatus || '"]') AS k, l_suppkey, l_returnflag, l_linestatus FROM lineitem""")
def stable_join_key(spark, sf_dir):
    """P24."""
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()
    return d.select(I.stable_key(F.col("l_suppkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus")).alias("k"), "l_suppkey", "l_returnflag", "l_linestatus")


@register("table_audit", "SELECT name, rows::BIGINT AS rows, expected::BIGINT AS expected, rows = expected AS complete FROM (SELECT 'nation' AS name, count(*) AS rows, 25 AS expected FROM nation UNION ALL SELECT 'region', count(*), 5 FROM region UNION ALL SELECT 'supplier', count(*), 7 FROM supplier)")
def table_audit(spark, sf_dir):
    """The last one is wrong on purpose."""
    return I.audit({n: table(spark, sf_dir, n) for n in ("nation", "region", "supplier")}, {"nation": 25, "region": 5, "supplier": 7})


@register("hash_formats", """SELECT doc_id, regexp_full_match(md5(text) || md5(lang), '[0-9a-f]{64}') AS is_sha256, regexp_full_match(substr(md5(text) || md5(lang), 1, 40), '[0-9a-f]{40}') AS is_commit, regexp_full_match(upper(sha256(text)), '[0-9a-f]{64}') AS upper_is_sha256 FROM documents""")
def hash_formats(spark, sf_dir):
    """P17."""
    d = table(spark, sf_dir, "documents")
    long = F.concat(F.md5("text"), F.md5("lang"))
    return d.select("doc_id", inventory.is_sha256(long).alias("is_sha256"), inventory.is_commit(F.substring(long, 1, 40)).alias("is_commit"), inventory.is_sha256(F.upper(F.sha2("text", 256))).alias("upper_is_sha256"))


@register("finite_values", """SELECT doc_id, CASE WHEN isfinite(x) THEN round(x, 9) END AS x FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'nan'::DOUBLE WHEN doc_id % 7 = 0 THEN 'infinity'::DOUBLE ELSE n_chars / 7.0::DOUBLE END AS x FROM documents)""")
def finite_values(spark, sf_dir):
    """P23."""
    from gristmill.operators.diagnostics import finite

    x = F.when(F.col("doc_id") % 5 == 0, float("nan")).when(F.col("doc_id") % 7 == 0, float("inf")).otherwise(F.col("n_chars") / 7.0)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(finite(x), 9).alias("x"))


@register("schema_privacy")
def schema_privacy(spark, sf_dir):
    """Protected fields of each table's schema; there is no SQL over schemas that both engines have."""
    rows = [(n, f) for n in ("documents", "benchmark", "conversations", "orders") for f in inventory.private_fields(table(spark, sf_dir, n).schema)]
    return spark.createDataFrame(rows, "name string, field string")


@register("file_inventory")
def file_inventory(spark, sf_dir):
    """Hashes of files, which SQL over tables doesn't reach."""
    return inventory.files(spark, sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")
