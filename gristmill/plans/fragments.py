"""Pieces of SQL that several queries' equivalents share, and the inputs they stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from gristmill.functions.text import PUNCTUATION
from gristmill.operators import chunking
from gristmill.plans.registry import table


def norm(x: str) -> str:
    """Normalised text in SQL: the articles go as tokens."""
    return f"array_to_string(list_filter(string_split_regex(translate(lower({x}), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')"


def norm_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(translate(lower({x}), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def lexical(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def fixed_cte(name: str, size: int, overlap: int) -> str:
    """CTE chunks_<name>: the fixed windows of all documents."""
    stride = max(1, size - overlap)
    return f"""w_{name} AS (SELECT doc_id::VARCHAR AS doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
chunks_{name} AS (SELECT '{name}::' || doc_id || '::' || i AS chunk_id, doc_id, i::INT AS chunk_index, array_to_string(w[i * {stride} + 1 : i * {stride} + {size}], ' ') AS text,
  len(w[i * {stride} + 1 : i * {stride} + {size}])::INT AS token_count
  FROM (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {size}) / {stride}::DOUBLE))::INT + 1)) AS i FROM w_{name} WHERE len(w) > 0))"""


def bm25_cte(queries: str, chunks: str, k: int, out: str = "bm25") -> str:
    """CTE `out`: (query_id, chunk_id, rank, score), from CTEs of (query_id, text) and (chunk_id, text)."""
    return f"""tok AS (SELECT chunk_id, {lexical('text')} AS t FROM {chunks}),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM tok) GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({lexical('text')}) AS term FROM {queries}) GROUP BY ALL),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM asked JOIN tf USING (term) JOIN idf USING (term) CROSS JOIN size GROUP BY query_id, chunk_id),
al AS (SELECT q.query_id, c.chunk_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM {queries}) q CROSS JOIN {chunks} c LEFT JOIN sc ON sc.query_id = q.query_id AND sc.chunk_id = c.chunk_id),
{out} AS (SELECT * FROM (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank, score FROM al) WHERE rank <= {k})"""


QUERIES = "q AS (SELECT item_id AS query_id, text FROM benchmark WHERE text IS NOT NULL)"
F128 = fixed_cte("fixed_128", 128, 19)
#: Documents that hold an item whole, after normalisation, are relevant to it.
RELEVANT = f"""nd AS (SELECT doc_id::VARCHAR AS doc_id, {norm('text')} AS n FROM documents),
rel AS (SELECT query_id, doc_id FROM (SELECT query_id, {norm('text')} AS n FROM q) x JOIN nd ON x.n <> '' AND contains(nd.n, x.n))"""


def queries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.selectExpr("item_id as query_id", "text").where("text is not null")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null")


_shared: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A part that several queries of a session start from: planned once and kept in memory and on disk once it is computed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _shared[key]


def release() -> None:
    """Forget the shared parts."""
    while _shared:
        _shared.popitem()[1].unpersist()


def fixed_128(spark, sf_dir):
    """Cut anew by each use: kept, the chunks would take more room than the texts."""
    return chunking.fixed_chunks(documents(spark, sf_dir), 128, 19, "fixed_128")
