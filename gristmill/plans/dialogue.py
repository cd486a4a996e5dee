"""Queries on dialogues and families."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import dialogue
from gristmill.plans.registry import register, table

H = """h AS (SELECT conv_id, turn, role, text, string_agg(upper(role) || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS query,
  lead(role) OVER w AS next_role, lead(text) OVER w AS target, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@register("dialogue_history", f"WITH {H} SELECT conv_id, turn, n::INT AS n_turns, md5(query) AS query_md5, length(query)::INT AS query_chars FROM h")
def dialogue_history(spark, sf_dir):
    """W5, P18."""
    h = dialogue.histories(table(spark, sf_dir, "conversations"))
    return h.select("conv_id", "turn", F.size("history").alias("n_turns"), F.md5("retrieval_query").alias("query_md5"), F.length("retrieval_query").alias("query_chars"))


@register("next_agent_turn", f"WITH {H} SELECT conv_id, turn, n::INT AS n_history, md5(query) AS query_md5, md5(target) AS target_md5 FROM h WHERE role = 'user' AND next_role = 'assistant'")
def next_agent_turn(spark, sf_dir):
    """P19, P20, W4."""
    c = dialogue.cases(table(spark, sf_dir, "conversations"), agent="assistant")
    return c.select("conv_id", "turn", F.size("history").alias("n_history"), F.md5("retrieval_query").alias("query_md5"), F.md5("target_agent_response").alias("target_md5"))


@register("one_case_per_conv", f"""WITH {H}, c AS (SELECT conv_id, turn, target, sha256('case-v1|' || conv_id || ':' || turn) AS selection_hash FROM h WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, arg_min(turn, selection_hash) AS turn, min(selection_hash) AS selection_hash, md5(arg_min(target, selection_hash)) AS target_md5 FROM c GROUP BY conv_id""")
def one_case_per_conv(spark, sf_dir):
    """D11, by the rule of our own: the smallest salted hash."""
    c = dialogue.cases(table(spark, sf_dir, "conversations"), agent="assistant").select("conv_id", "turn", "target_agent_response")
    one = dialogue.one_per(c, "conv_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "case-v1")
    return one.select("conv_id", "turn", "selection_hash", F.md5("target_agent_response").alias("target_md5"))


@register("family_keys", r"""WITH t AS (SELECT c_custkey, lower(trim(c_mktsegment)) AS d, lower(trim(c_name)) AS n, lower(trim(c_mktsegment || ' #' || c_nationkey)) AS s FROM customer)
SELECT c_custkey, d || '::' || trim(regexp_replace(regexp_replace(n, '\s*#\d+$', ''), '\s+', ' ', 'g')) AS family, d || '::' || trim(regexp_replace(regexp_replace(n, '\s+#\d+$', ''), '\s+', ' ', 'g')) AS family_spaced,
  d || '::' || trim(regexp_replace(regexp_replace(s, '\s+#\d+$', ''), '\s+', ' ', 'g')) AS segment_family FROM t""")
def family_keys(spark, sf_dir):
    """Names such as Customer#1 tell the two rules apart."""
    c = table(spark, sf_dir, "customer")
    d, n = F.col("c_mktsegment"), F.col("c_name")
    s = F.concat(d, F.lit(" #"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", dialogue.family_key(d, n).alias("family"), dialogue.family_key(d, n, spaced=True).alias("family_spaced"), dialogue.family_key(d, s, spaced=True).alias("segment_family"))


@register("family_sizes", r"""WITH f AS (SELECT lower(trim(c_mktsegment)) AS domain, c_nationkey AS family, count(*) AS n FROM customer GROUP BY ALL) SELECT domain, n::BIGINT AS family_size, count(*)::BIGINT AS families FROM f GROUP BY ALL""")
def family_sizes(spark, sf_dir):
    """Counts of counts."""
    f = table(spark, sf_dir, "customer").groupBy(F.lower(F.trim("c_mktsegment")).alias("domain"), "c_nationkey").agg(F.count("*").alias("family_size"))
    return f.groupBy("domain", "family_size").agg(F.count("*").alias("families"))
