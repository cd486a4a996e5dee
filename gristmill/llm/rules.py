"""Quality rules with host-level verdicts, in DataFrame and SQL functions alone.

Each document is measured and tested by fixed rules.  The failures of each rule are summed by host (`source`), and a host's
failure rate of a rule is shrunk towards that of all hosts by the rule's own beta prior, fitted to the hosts by moments.  Hosts
of which a shrunk rate is `reject_at` or more lose all their documents.

Edge cases: a null or empty text has no words and fails; a null host is a host of its own; a single host, or hosts of
equal rates, get the strongest prior, so that none is rejected unless all fail; an empty table gives an empty result; repeated rows count each; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialise, read

SPACE = r"[\\x20\\x09-\\x0D]"
WORDS = rf"array_remove(split(text, '{SPACE}+'), '')"
#: Word positions inside 3-word windows that occur twice or more: windows are sorted by hash with their place, those
#: with an equal neighbour kept, and each adds the words that the kept window before it doesn't cover.
REPEATED = """
element_at(transform(array(words), w -> if(size(w) < 4, 0L,
 element_at(transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as p)))), s ->
  aggregate(
   sort_array(transform(filter(s, (x, j) -> if(j > 0, s[j - 1].h = x.h, false) or if(j < size(s) - 1, s[j + 1].h = x.h, false)), x -> x.p)),
   struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)), 1))), 1)
"""
LINES = rf"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
REJECT_AT = 0.5
MAX_HOSTS = 200_000
SALTS = 64


def measure(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", "host", "text", F.expr(WORDS).alias("words"), F.expr(LINES).alias("lines"))
    d = d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.expr(f"cast(length(text) - regexp_count(text, '{SPACE}') as long)").alias("word_chars"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') as long)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr(REPEATED).alias("n_repeat_words"),
    )
    return d.withColumns({rule: F.expr(test) for rule, test in RULES.items()}).withColumn("base_failed", F.expr(" or ".join(RULES)))


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, a column for each rule's failures, rates, rate): of each rule (failed + a) / (n + a + b), the prior beta(a, b)
    fitted by moments; `rate` is the highest."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    mean = hosts.agg(F.sum("n").alias("docs"), F.count("*").alias("hosts"), *[F.try_divide(F.sum(r), F.sum("n")).alias(f"m_{r}") for r in RULES])
    spread = hosts.crossJoin(F.broadcast(mean)).agg(F.max("hosts").alias("hosts"), F.max("docs").alias("docs"), *[F.max(f"m_{r}").alias(f"m_{r}") for r in RULES], *[F.try_divide(F.sum(F.expr(f"n * pow({r} / n - m_{r}, 2)")), F.sum("n")).alias(f"v_{r}") for r in RULES])
    strength = lambda r: F.expr("least(greatest(coalesce(try_divide(m_{0} * (1 - m_{0}), greatest(v_{0} - m_{0} * (1 - m_{0}) * hosts / docs, 0)) - 1, 10000), 1), 10000)".format(r))
    prior = spread.select(*[F.col(f"m_{r}") for r in RULES], *[strength(r).alias(f"s_{r}") for r in RULES])
    rated = hosts.crossJoin(F.broadcast(prior)).select("host", "n", *RULES, *[F.expr(f"({r} + m_{r} * s_{r}) / (n + s_{r})").alias(f"{r}_rate") for r in RULES])
    return rated.withColumn("rate", F.greatest(*[f"{r}_rate" for r in RULES]))


def judge(docs: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """A row for each document: its measures, the fixed rules' verdict, its host's shrunk failure rate and the final verdict.

    The measures are written once to the shared folder.  Up to MAX_HOSTS hosts are broadcast (a checked size); beyond
    that the documents of a host are dealt to SALTS keys, so a host with a third of all rows doesn't meet in one task.
    """
    measured = materialise(measure(docs), "rules")
    rates = materialise(host_rates(measured), "hosts").select(F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("no_host"), F.col("rate").alias("host_rate"))
    m = measured.withColumns({"h": F.coalesce("host", F.lit("")), "no_host": F.col("host").isNull()})
    if rates.count() <= MAX_HOSTS:
        joined = m.join(F.broadcast(rates), ["h", "no_host"])
    else:
        salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS))
        joined = m.withColumn("salt", salt).join(rates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["h", "no_host", "salt"])
    kept = ~F.col("base_failed") & (F.col("host_rate") < reject_at)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("host_rate", 6).alias("host_rate"))


def query(spark, sf_dir):
    return judge(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM f WHERE len(w) >= 4),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT f.doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM f LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, sum((n_words < 50)::INT)::DOUBLE AS f1, sum((100 * n_repeat_words > 50 * n_words)::INT)::DOUBLE AS f2 FROM b GROUP BY host),
a AS (SELECT sum(f1) / sum(n) AS m1, sum(f2) / sum(n) AS m2, count(*) AS hosts, sum(n) AS docs FROM h),
v AS (SELECT max(m1) AS m1, max(m2) AS m2, max(hosts) AS hosts, max(docs) AS docs, sum(n * pow(f1 / n - m1, 2)) / sum(n) AS v1, sum(n * pow(f2 / n - m2, 2)) / sum(n) AS v2 FROM h, a),
p AS (SELECT m1, m2, least(greatest(coalesce(m1 * (1 - m1) / nullif(greatest(v1 - m1 * (1 - m1) * hosts / docs, 0), 0) - 1, 10000), 1), 10000) AS s1,
  least(greatest(coalesce(m2 * (1 - m2) / nullif(greatest(v2 - m2 * (1 - m2) * hosts / docs, 0), 0) - 1, 10000), 1), 10000) AS s2 FROM v),
r AS (SELECT host, greatest((f1 + m1 * s1) / (n + s1), (f2 + m2 * s2) / (n + s2)) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < 0.5 AS kept, round(rate, 6) AS host_rate
FROM b JOIN r ON b.host IS NOT DISTINCT FROM r.host
"""
