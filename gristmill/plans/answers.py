"""Queries on answers and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import answers as A
from gristmill.functions.text import words
from gristmill.plans.fragments import words as sql_words
from gristmill.plans.registry import register, table
from gristmill.plans.retrieval import GRADED, graded
from gristmill.plans.texts import TURNS, pairs

#: Raw outputs as models write them: leading phrases, quotes, cites and marks by turn.
RAW = f"""{TURNS}, raw AS (SELECT conv_id, turn, question, answer, CASE turn % 4 WHEN 0 THEN 'Answer: ' || answer || ' [2]' WHEN 1 THEN '[1] "' || answer || '".' WHEN 2 THEN ' The answer is ' || answer || '; ' ELSE answer END AS raw FROM p)"""


def raw_outputs(spark, sf_dir):
    m, a = F.col("turn") % 4, F.col("answer")
    raw = F.when(m == 0, F.concat(F.lit("Answer: "), a, F.lit(" [2]"))).when(m == 1, F.concat(F.lit('[1] "'), a, F.lit('".'))).when(m == 2, F.concat(F.lit(" The answer is "), a, F.lit("; "))).otherwise(a)
    return pairs(spark, sf_dir).withColumn("raw", raw)


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _leads(x: str) -> str:
    for lead in (r"^\s*\[\d+\]\s*", r"(?i)^\s*(answer|final answer)\s*:\s*", r"(?i)^\s*the answer is\s+"):
        x = f"regexp_replace({x}, '{lead}', '')"
    return _trim(f"""regexp_replace(regexp_replace({_trim(x)}, '^["''`]+', ''), '["''`]+$', '')""")


def _response(x: str) -> str:
    first = _leads(_trim(f"string_split_regex({_trim(x)}, '\\r\\n|[\\n\\r]')[1]"))
    return f"""regexp_replace(regexp_replace(regexp_replace({first}, '\\s+\\[\\d+\\]\\s*$', ''), '(?i)\\s*\\([^)]*implies[^)]*\\)\\s*$', ''), '[ .;:]+$', '')"""


def _complete(x: str) -> str:
    return _leads(f"array_to_string(list_filter(list_transform(string_split_regex({_trim(x)}, '\\r\\n|[\\n\\r]'), lambda y: {_trim('y')}), lambda y: y <> ''), chr(10))")


@register(
    "normalize_response",
    f"""WITH {RAW}, n AS (SELECT conv_id, turn, {_response('raw')} AS r, {_complete('raw')} AS c FROM raw)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(r), 'unanswerable|not answerable|not supported') THEN 'unanswerable' ELSE r END AS response, md5(CASE WHEN lower(c) IN ('unanswerable', 'not answerable', 'not supported') THEN 'unanswerable' ELSE c END) AS complete_md5 FROM n""",
)
def normalize_response(spark, sf_dir):
    """P7, P8."""
    r = raw_outputs(spark, sf_dir)
    return r.select("conv_id", "turn", A.normalize_response(F.col("raw")).alias("response"), F.md5(A.normalize_complete(F.col("raw"))).alias("complete_md5"))


def asked(question: Column) -> Column:
    """Questions of each type, by turn."""
    lead = F.get(F.array(*[F.lit(x) for x in ("how many ", "when ", "who ", "where did it start ", "what ", "which ", "")]), (F.col("conv_id") + F.col("turn")) % 7)
    return F.concat(lead, question)


@register("compress_answer")
def compress_answer(spark, sf_dir):
    """Word boundaries of any script, which the other engine's expressions don't have; held against plain Python in the tests."""
    r = raw_outputs(spark, sf_dir)
    return r.select("conv_id", "turn", A.compress_answer(asked(F.col("question")), F.col("answer")).alias("compressed"))


_BARE = A.BARE_QUANTITY.replace("'", "''")


@register(
    "refine_flag",
    f"""WITH {RAW}, n AS (SELECT conv_id, turn, array_to_string({sql_words('answer')}[1:1 + (conv_id + turn) % 9], ' ') AS a FROM raw)
SELECT conv_id, turn, CASE WHEN a = '' OR a = 'unanswerable' OR (len(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+')) <= 4 AND NOT regexp_matches(a, '[\\[\\]():]')) OR regexp_full_match(a, '{_BARE}', 'i') THEN false
  ELSE len(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+')) >= 7 OR regexp_matches(a, '[\\[\\]():]') OR regexp_matches(lower(a), '{'|'.join(A.REFINE_PHRASES)}') END AS refine FROM n""",
)
def refine_flag(spark, sf_dir):
    """P10: the first one to nine words of each answer."""
    r = raw_outputs(spark, sf_dir)
    a = F.array_join(F.slice(words("answer"), F.lit(1), (F.lit(1) + (F.col("conv_id") + F.col("turn")) % 9).cast("int")), " ")
    return r.select("conv_id", "turn", A.should_refine(a).alias("refine"))


@register("extractive_answer")
def extractive_answer(spark, sf_dir):
    """Each benchmark-like question against its answer turn; held against plain Python in the tests."""
    r = pairs(spark, sf_dir)
    return r.select("conv_id", "turn", A.extractive_answer(F.col("question"), F.col("answer")).alias("extracted"))


@register(
    "extractive_documents",
    r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')),
  lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(matched queries:|title:|\[\d+\]\s+title:)')) AS l, text, lang, source FROM documents WHERE text <> ''),
c AS (SELECT doc_id, lang, CASE WHEN len(l) > 0 THEN array_to_string(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^#+\s*', ''), '^[-*]\s*', '')), '. ') ELSE text END AS t FROM d),
s AS (SELECT doc_id, lang, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS p FROM c),
q AS (SELECT lang, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), lambda t: length(t) > 2) AS terms FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1),
u AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i, terms FROM s JOIN q USING (lang)),
o AS (SELECT *, list_distinct(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+')) AS own FROM u),
z AS (SELECT doc_id, i, s, len(own) >= 4 AS long, len(list_intersect(terms, own)) + CASE WHEN len(list_filter(terms, lambda t: contains(lower(s), t))) > 0 THEN 0.2::DOUBLE ELSE 0 END AS score FROM o),
a AS (SELECT *, max(long::INT) OVER (PARTITION BY doc_id) AS any_long FROM z),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN any_long = 1 THEN score ELSE 0 END DESC, i) AS k FROM a WHERE long OR any_long = 0)
SELECT doc_id, md5(regexp_replace(regexp_replace(substr(string_agg(s, ' ' ORDER BY i), 1, 360), '^\s+', ''), '\s+$', '')) AS answer_md5 FROM b WHERE k <= 3 GROUP BY doc_id""",
)
def extractive_documents(spark, sf_dir):
    """P13 over all documents: the question is the text of the first document of the language."""
    d = table(spark, sf_dir, "documents")
    q = d.groupBy("lang").agg(F.min_by("text", "doc_id").alias("question"))
    own = d.where("text <> ''").join(F.broadcast(q), "lang")
    return own.select("doc_id", F.md5(A.extractive_answer(F.col("question"), F.col("text"))).alias("answer_md5"))


@register(
    "pack_context",
    f"""WITH {GRADED}, c AS (SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM graded WHERE rank <= 4 GROUP BY query_id),
w AS (SELECT query_id, {sql_words('context')} AS w, len({sql_words('q.text')}) + 40 AS overhead FROM c JOIN q USING (query_id))
SELECT query_id, md5(array_to_string(w[1:least(len(w), 400 - overhead)], ' ')) AS packed_md5, (len(w) + overhead)::INT AS full_tokens, (least(len(w), 400 - overhead) + overhead)::INT AS used_tokens, len(w) > 400 - overhead AS truncated FROM w""",
)
def pack_context(spark, sf_dir):
    """Four contexts cut to what 400 words leave beside the question and 40 words of prompt."""
    g = graded(spark, sf_dir).where("rank <= 4").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("t"))
    q = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), (F.size(words("text")) + 40).alias("overhead"))
    rows = g.join(q, "query_id").select("query_id", "overhead", words(A.context_of(F.col("t.text"))).alias("tokens"))
    p = A.pack(F.col("tokens"), F.col("overhead"), 400)
    return rows.select("query_id", F.md5(p["packed"]).alias("packed_md5"), p["full_tokens"].alias("full_tokens"), p["used_tokens"].alias("used_tokens"), p["truncated"].alias("truncated"))


_Q = "'{}'".format(A.GROUNDED_USER.replace("'", "''").replace("\n\n{q}", "{q}")).replace("{q}", "' || text || '").replace("{c}", A.CONTEXT_PLACE)


@register("prompt_digests", f"""SELECT item_id, md5({_Q}) AS user_md5, length({_Q})::INT AS user_chars, sha256('[{{"content": "' || '{A.GROUNDED_SYSTEM.replace("'", "''")}' || '", "role": "system"}}, {{"content": "' || replace(replace(replace({_Q}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '", "role": "user"}}]') AS prompt_sha256 FROM benchmark""")
def prompt_digests(spark, sf_dir):
    """P11, P12."""
    b = table(spark, sf_dir, "benchmark")
    user = F.get(A.qa_messages(F.col("text"), F.lit(A.CONTEXT_PLACE)), F.lit(1))["content"]
    return b.select("item_id", F.md5(user).alias("user_md5"), F.length(user).alias("user_chars"), A.prompt_hash(F.col("text")).alias("prompt_sha256"))
