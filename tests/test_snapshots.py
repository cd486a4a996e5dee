"""Snapshots, chained manifests, the suite's report, and stages that resume."""

import os
import signal
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill.operators import snapshots as S
from gristmill.sources import inventory
from gristmill.streaming.stages import Stages, fingerprint

ROOT = str(Path(__file__).resolve().parents[1])


def rows(spark, data):
    return spark.createDataFrame(data, "k int, v string")


def test_table_changes(spark):
    data = [(i, f"v{i}") for i in range(200)]
    before = S.table_snapshot(rows(spark, data), "t", "k", parts=8)
    assert S.changes(before, S.table_snapshot(rows(spark, data[::-1]).repartition(7), "t", "k", parts=8)).count() == 0
    changed = S.changes(before, S.table_snapshot(rows(spark, [*data[:-1], (199, "other")]), "t", "k", parts=8)).collect()
    assert [(r.status, r.rows_before == r.rows_after) for r in changed] == [("changed", True)]
    doubled = S.changes(before, S.table_snapshot(rows(spark, [*data, data[3], data[3]]), "t", "k", parts=8)).collect()  # xors cancel
    assert [(r.status, r.rows_after - r.rows_before) for r in doubled] == [("changed", 2)]
    gone = S.changes(before, S.table_snapshot(rows(spark, []), "t", "k", parts=8)).collect()
    assert {r.status for r in gone} == {"lost"} and sum(r.rows_before for r in gone) == 200
    assert {r.status for r in S.changes(S.table_snapshot(rows(spark, []), "t", "k", parts=8), before).collect()} == {"added"}
    assert S.table_snapshot(rows(spark, [(None, None)]), "t", "k").count() == 1


def test_file_changes(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n * 5)
    before = S.file_snapshot(inventory.files(spark, str(tmp_path)), "f").collect()
    (tmp_path / "a").write_text("other")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("new")
    b = spark.createDataFrame(before, "subject string, part string, rows long, digest string")
    got = {r.part.rsplit("/", 1)[1]: r.status for r in S.changes(b, S.file_snapshot(inventory.files(spark, str(tmp_path)), "f")).collect()}
    assert got == {"a": "changed", "b": "lost", "d": "added"}


def test_manifest(spark):
    a, b, c = (rows(spark, [(i, n) for i in range(5)]) for n in "abc")
    stages = S.suite([S.stage_row(x, n, i) for i, (n, x) in enumerate(zip("abc", (a, b, c)))])
    manifest = spark.createDataFrame(S.chained(stages).collect())
    assert S.broken(manifest, stages).count() == 0
    other = S.suite([S.stage_row(a, "a", 0), S.stage_row(a, "b", 1)])
    assert {r.stage: r.problem for r in S.broken(manifest, other).collect()} == {"b": "output differs", "c": "no output"}
    assert {r.stage: r.problem for r in S.broken(manifest.where("stage <> 'c'"), stages).collect()} == {"c": "not in the manifest"}
    forged = manifest.withColumn("digest", F.when(F.col("stage") == "a", F.lit("x")).otherwise(F.col("digest")))
    seen = stages.withColumn("digest", F.when(F.col("stage") == "a", F.lit("x")).otherwise(F.col("digest")))
    assert {r.stage: r.problem for r in S.broken(forged, seen).collect()} == dict.fromkeys("abc", "chain is broken")


def test_suite(spark):
    t = rows(spark, [(1, "a"), (2, "b")])
    good = S.suite([S.count_check("n", t, 2), S.check(spark, "e", t.where("k > 9"), F.col("k")), S.fields_check(spark, "f", t, ("text",))])
    S.require(good)
    bad = good.unionByName(S.count_check("m", t, 3)).unionByName(S.check(spark, "x", t, F.col("k"))).unionByName(S.fields_check(spark, "v", t.select(F.struct("v").alias("s")), ("v",)))
    assert {r.check: (r.failures, r.example) for r in bad.where("not passed").collect()} == {"m": (1, "2 rows, not 3"), "x": (2, "1"), "v": (1, "s.v")}
    with pytest.raises(RuntimeError, match="m: 1 .*v: 1 .*x: 2"):
        S.require(bad)


def pipeline(spark, root, data, built, factor=2, fail=False):
    """Two stages on a source; the second can fail while it is written."""
    s = Stages(spark, root)

    def first(df, factor):
        built.append("first")
        return df.withColumn("k", F.col("k") * factor)

    def second(a, b):
        built.append("second")
        out = a.groupBy("v").agg(F.sum("k").alias("k")).join(b.select("v").distinct(), "v")
        return out.withColumn("k", F.when(F.lit(fail), F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("k")))

    src = s.source(rows(spark, data))
    a = s.run("first", first, [src], factor=factor)
    return s.run("second", second, [a, src])


def test_stages_resume(spark, tmp_path):
    data, root, built = [(i, f"v{i % 7}") for i in range(100)], f"file://{tmp_path}/a", []
    with pytest.raises(Exception, match="killed"):
        pipeline(spark, root, data, built, fail=True)
    assert built == ["first", "second"]
    out = pipeline(spark, root, data, built)  # the first stage is there, the second left no mark
    assert built == ["first", "second", "second"] and not out.resumed
    whole = pipeline(spark, f"file://{tmp_path}/b", data, [])
    assert sorted(map(tuple, out.rows.collect())) == sorted(map(tuple, whole.rows.collect()))
    again = pipeline(spark, root, data[::-1], built)  # the same content in another order
    assert again.resumed and len(built) == 3 and again.identity == out.identity
    pipeline(spark, root, data, built, factor=3)
    pipeline(spark, root, data[1:], built)
    assert built[3:] == ["first", "second"] * 2


def test_stages_dont_trust_a_mark_alone(spark, tmp_path):
    data, root, built = [(i, f"v{i % 7}") for i in range(100)], f"file://{tmp_path}", []
    want = sorted(map(tuple, pipeline(spark, root, data, built).rows.collect()))
    lost = next(tmp_path.glob("first-*/attempt-*/part-*.parquet"))
    lost.unlink()
    spark.catalog.clearCache()
    again = pipeline(spark, root, data, built)
    assert built == ["first", "second", "first"] and sorted(map(tuple, again.rows.collect())) == want
    for part in tmp_path.glob("second-*/attempt-*/part-*.parquet"):
        part.write_bytes(part.read_bytes()[:20])
    assert sorted(map(tuple, pipeline(spark, root, data, built).rows.collect())) == want and built[3:] == ["second"]


def test_stages_after_a_kill(spark, tmp_path):
    """A process that is killed in its second stage; another one resumes."""
    code = textwrap.dedent(f"""
        import os, signal, sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F
        from gristmill.streaming.stages import Stages
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        s = Stages(spark, "file://{tmp_path}")
        src = s.source(spark.range(50).withColumnRenamed("id", "k"))
        a = s.run("double", lambda d: d.selectExpr("k * 2 as k"), [src])
        s.run("kill", lambda d: os.kill(os.getpid(), signal.SIGKILL), [a])
    """)
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, timeout=300)
    assert done.returncode == -signal.SIGKILL
    built, s = [], Stages(spark, f"file://{tmp_path}")
    src = s.source(spark.range(50).withColumnRenamed("id", "k"))
    a = s.run("double", lambda d: built.append(1), [src])
    assert a.resumed and not built and sorted(r.k for r in a.rows.collect()) == list(range(0, 100, 2))


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, 0.1, None), (2, float("nan"), ["a", None])], "b int, `a.x` double, c array<string>")
    assert fingerprint(df) == fingerprint(df.select("c", "`a.x`", "b").repartition(3))
    assert fingerprint(df)[1] != fingerprint(df.withColumn("b", F.col("b") + 1))[1] and fingerprint(df.limit(0))[0] == 0
