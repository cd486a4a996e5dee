"""The pipeline's stages, each judged on its own input, and the registered queries."""

import hashlib

import corpus_pipeline
from gristmill.llm import compression, decontamination
from gristmill.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))

    good = corpus_pipeline.quality(spark, docs, SF).cache()
    judged = {r.doc_id: r.predicted for r in compression.classify(docs, labels).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {d for d, p in judged.items() if p}

    one = corpus_pipeline.one_of_each_group(spark, good, SF).cache()
    want = brute.components({r.doc_id: brute.shingle_set(r.text, 5) for r in good.collect()}, 80)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {d for d, c in want.items() if c == d}

    clean = corpus_pipeline.uncontaminated(spark, one, SF).cache()
    leaks = {r.doc_id for r in decontamination.contaminated(one, benchmark).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaks

    safe = corpus_pipeline.redacted(spark, clean, SF).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    assert safe.columns == columns and safe.count() == clean.count()
    for r in safe.collect():
        spans = brute.base_spans(before[r.doc_id])
        assert not brute.base_spans(r.text)
        assert spans or r.text == before[r.doc_id]

    last = {r.doc_id: r for r in corpus_pipeline.encoded(spark, safe, SF).collect()}
    assert all(last[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in safe.collect())
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in last.values()}


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_rules_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLES["op6_quality_rules"]).df()
    got = QUERIES["op6_quality_rules"](spark, SF).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").reset_index(drop=True).astype(str).equals(want.sort_values("doc_id").reset_index(drop=True).astype(str))
