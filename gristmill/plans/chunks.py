"""Queries on chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.tokens import from_file, token_count
from gristmill.operators import chunking, subword
from gristmill.plans.fragments import documents, fixed_cte
from gristmill.plans.registry import register

_DIGEST = "SELECT chunk_id, doc_id, chunk_index, token_count, md5(text) AS text_md5 FROM {0}"


def _digest(chunks):
    return chunks.select("chunk_id", "doc_id", "chunk_index", "token_count", F.md5("text").alias("text_md5"))


@register("chunk_fixed_128", f"WITH {fixed_cte('fixed_128', 128, 19)} {_DIGEST.format('chunks_fixed_128')}")
def chunk_fixed_128(spark, sf_dir):
    """C5, C12."""
    return _digest(chunking.build_chunks(documents(spark, sf_dir), chunking.SPECS[0]))


@register("chunk_fixed_254", f"WITH {fixed_cte('fixed_254', 254, 38)} {_DIGEST.format('chunks_fixed_254')}")
def chunk_fixed_254(spark, sf_dir):
    """C5, C12."""
    return _digest(chunking.build_chunks(documents(spark, sf_dir), chunking.SPECS[1]))


@register("chunk_recursive_254")
def chunk_recursive_254(spark, sf_dir):
    """Sequential, so it is held against plain Python in the tests."""
    return _digest(chunking.build_chunks(documents(spark, sf_dir), chunking.SPECS[2]))


@register(
    "chunk_sentence_254",
    r"""WITH s AS (SELECT doc_id::VARCHAR AS doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM
  (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') AS x FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, i, list_filter(string_split_regex(s, '\s+'), lambda t: t <> '') AS w FROM s)
SELECT doc_id, count(*)::BIGINT AS sentences, sum(len(w))::BIGINT AS words, sum((len(w) > 254)::INT)::BIGINT AS oversize FROM l GROUP BY doc_id""",
)
def chunk_sentence_254(spark, sf_dir):
    """Sentence and word totals of the chunks match those of the sentences they are packed from, by document."""
    docs = documents(spark, sf_dir)
    from gristmill.functions.text import sentences, words

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(sentences("text")).alias("s"))
    counts = parts.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum((F.size(words("s")) > 254).cast("long")).alias("oversize"))
    chunks = chunking.build_chunks(docs, chunking.SPECS[3]).groupBy("doc_id").agg(F.sum("token_count").alias("words"))
    return counts.join(chunks, "doc_id").select("doc_id", "sentences", "words", "oversize")


@register("chunk_sentences_packed")
def chunk_sentences_packed(spark, sf_dir):
    """The chunks themselves; a greedy fold, held against plain Python in the tests."""
    return _digest(chunking.build_chunks(documents(spark, sf_dir), chunking.SPECS[3]))


@register("chunk_semantic")
def chunk_semantic(spark, sf_dir):
    """C8, C9, W6 with the stand-in encoder; a fold, held against plain Python in the tests."""
    return _digest(chunking.build_chunks(documents(spark, sf_dir), {"type": "semantic", "name": "semantic_254", "size": 254, "threshold": 0.2}))


@register(
    "chunk_counts",
    f"""WITH {fixed_cte('fixed_128', 128, 19)}, {fixed_cte('fixed_254', 254, 38)}
SELECT chunker, lang, count(*)::BIGINT AS chunks, sum(token_count)::BIGINT AS tokens, max(token_count)::INT AS longest FROM
(SELECT 'fixed_128' AS chunker, doc_id, token_count FROM chunks_fixed_128 UNION ALL SELECT 'fixed_254', doc_id, token_count FROM chunks_fixed_254) c
JOIN (SELECT doc_id::VARCHAR AS doc_id, lang FROM documents) d USING (doc_id) GROUP BY chunker, lang""",
)
def chunk_counts(spark, sf_dir):
    """The union over chunkers, summed by chunker and language."""
    docs = documents(spark, sf_dir)
    c = chunking.build_all(docs, chunking.SPECS[:2])
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    return c.join(d, "doc_id").groupBy("chunker", "lang").agg(F.count("*").alias("chunks"), F.sum("token_count").cast("long").alias("tokens"), F.max("token_count").alias("longest"))


#: Of the queries by sub-words; any other file of the same kind can be given to the operators.
VOCABULARY = "byte_bpe_50k.json"


def tokenizer():
    import public_tokenizers

    return from_file(public_tokenizers.path(VOCABULARY))


@register("rule_sentences")
def rule_sentences(spark, sf_dir):
    """The sentences of all documents by the token rules."""
    from gristmill.functions.text import rule_sentences as split

    return documents(spark, sf_dir).select("doc_id", F.posexplode_outer(split("text")).alias("position", "sentence")).where("sentence is not null").select("doc_id", "position", F.md5("sentence").alias("sentence_md5"))


@register("subword_counts")
def subword_counts(spark, sf_dir):
    """C1."""
    return documents(spark, sf_dir).select("doc_id", token_count("text", tokenizer()).alias("tokens"))


@register("subword_sentence_counts")
def subword_sentence_counts(spark, sf_dir):
    """C8."""
    c = subword.sentence_counts(documents(spark, sf_dir), tokenizer())
    return c.select("doc_id", "position", F.md5("sentence").alias("sentence_md5"), "first", "continuation")


def _subword(name: str, spec: dict) -> None:
    def query(spark, sf_dir):
        return _digest(subword.build_chunks(documents(spark, sf_dir), spec, tokenizer()))

    query.__doc__ = f"C3-C7, C9, C12 by sub-words: {spec['name']}; held against plain Python in the tests."
    register(f"subword_{name}")(query)


for _spec in subword.SPECS:
    _subword(_spec["name"], _spec)
_subword("semantic_254", {"type": "semantic", "name": "semantic_254", "size": 254, "threshold": 0.2})
