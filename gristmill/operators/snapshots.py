"""Integrity suite (T6): snapshots before and after, stage manifests chained by digest, checks as rows.

A table's snapshot is a row for each part, a part being the rows of one bucket of the key's md5: number of rows and a digest
that doesn't hang on their order, so that it comes from one aggregate of any partitioning.  Files are snapshot by their path
and content hash.  Two snapshots are told apart by a join, and what was to stay and didn't is a row of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.inventory import private_fields
from gristmill.sources.jsonl import HASH, with_hash

PARTS = 16


def _number(hexadecimal: Column, digits: int, at: int = 1) -> Column:
    return F.conv(F.substring(hexadecimal, at, digits), 16, 10).cast("long")


def digest(row_sha256: Column | str = HASH) -> Column:
    """An aggregate: the md5 of (rows, xor and sum of parts of the row hashes).

    Repeated rows cancel in the xor and count in the sum, and the other way round for exchanged parts.
    """
    h = F.col(row_sha256) if isinstance(row_sha256, str) else row_sha256
    mixed, total = F.coalesce(F.bit_xor(_number(h, 15)), F.lit(0)), F.coalesce(F.sum(_number(h, 8, 17)), F.lit(0))
    return F.md5(F.concat_ws("|", F.count(F.lit(1)).cast("string"), mixed.cast("string"), total.cast("string")))


def table_snapshot(rows: DataFrame, name: str, key: str, columns: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """(subject, part, rows, digest) of a table's parts. Columns that aren't text or whole numbers have to be formatted before."""
    own = with_hash(rows.select(*(columns or rows.columns)))
    part = (_number(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 4) % parts).cast("int")
    return own.groupBy(F.lit(name).alias("subject"), part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), digest().alias("digest"))


def file_snapshot(files: DataFrame, name: str) -> DataFrame:
    """The same of an inventory (path, bytes, sha256): each file is a part, under its path."""
    return files.select(F.lit(name).alias("subject"), F.col("path").alias("part"), F.col("bytes").alias("rows"), F.col("sha256").alias("digest"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subject, part, status, rows_before, rows_after): parts that were added, lost or changed."""
    b = before.select("subject", "part", F.col("rows").alias("rows_before"), F.col("digest").alias("before"))
    a = after.select("subject", "part", F.col("rows").alias("rows_after"), F.col("digest").alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "lost").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return b.join(a, ["subject", "part"], "full").withColumn("status", status).where("status <> 'same'").select("subject", "part", "status", "rows_before", "rows_after")


#: What a chain starts from.
ORIGIN = "0" * 64
STAGE = "stage string, position int, rows long, digest string"


def stage_row(output: DataFrame, stage: str, position: int) -> DataFrame:
    """STAGE of a stage's output, whose rows have hashes."""
    own = output if HASH in output.columns else with_hash(output)
    return own.agg(F.count(F.lit(1)).alias("rows"), digest().alias("digest")).select(F.lit(stage).alias("stage"), F.lit(position).alias("position"), "rows", "digest")


def chained(stages: DataFrame) -> DataFrame:
    """`stages` with `chain`: the hash of the chain before, the stage's name, its rows and digest.

    A chain is one sequence and has a row for each stage of a program, so it is folded in one array.
    """
    s = stages.agg(F.sort_array(F.collect_list(F.struct("position", "stage", "rows", "digest"))).alias("s"))
    zero = F.struct(F.lit(ORIGIN).alias("chain"), F.array().cast("array<string>").alias("all"))

    def step(held: Column, x: Column) -> Column:
        link = F.sha2(F.concat_ws("|", held["chain"], x["stage"], x["rows"].cast("string"), x["digest"]), 256)
        return F.struct(link.alias("chain"), F.concat(held["all"], F.array(link)).alias("all"))

    links = s.select("s", F.aggregate("s", zero, step)["all"].alias("links"))
    return links.select(F.explode(F.arrays_zip("s", "links")).alias("x")).select("x.s.stage", "x.s.position", "x.s.rows", "x.s.digest", F.col("x.links").alias("chain"))


def broken(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """(stage, position, problem) of a chained manifest against the stages observed now: a stage that is missing on a side,
    an output that changed, and links that don't follow from the manifest's own rows."""
    again = chained(manifest.drop("chain")).select("stage", "position", F.col("chain").alias("follows"))
    m = manifest.select("stage", "position", F.struct("rows", "digest").alias("said"), "chain").join(again, ["stage", "position"])
    o = observed.select("stage", "position", F.struct("rows", "digest").alias("seen"))
    problem = F.when(F.col("said").isNull(), "not in the manifest").when(F.col("seen").isNull(), "no output").when(F.col("said") != F.col("seen"), "output differs").when(F.col("chain") != F.col("follows"), "chain is broken")
    return m.join(o, ["stage", "position"], "full").withColumn("problem", problem).where("problem is not null").select("stage", "position", "problem")


def check(spark: SparkSession, name: str, failures: DataFrame, what: Column) -> DataFrame:
    """(check, passed, failures, example) of a table that is empty where all is well."""
    return failures.agg(F.count(F.lit(1)).alias("failures"), F.min(what.cast("string")).alias("example")).select(F.lit(name).alias("check"), (F.col("failures") == 0).alias("passed"), "failures", "example")


def count_check(name: str, rows: DataFrame, expected: int) -> DataFrame:
    """A table of another size than it should have fails once."""
    n = F.count(F.lit(1))
    return rows.agg((n == expected).alias("passed"), (n != expected).cast("long").alias("failures"), F.when(n != expected, F.concat(n.cast("string"), F.lit(f" rows, not {expected}"))).alias("example")).select(F.lit(name).alias("check"), "passed", "failures", "example")


def fields_check(spark: SparkSession, name: str, rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields that a table must not have, anywhere in its schema."""
    found = private_fields(rows.schema, fields)
    return spark.createDataFrame([(name, not found, len(found), found[0] if found else None)], "check string, passed boolean, failures long, example string")


def suite(checks: list[DataFrame]) -> DataFrame:
    """All checks as one table."""
    return reduce(DataFrame.unionByName, checks)


def require(report: DataFrame) -> None:
    """Raise where a check failed, with all that did."""
    bad = report.where("not passed").orderBy("check").collect()
    if bad:
        raise RuntimeError("; ".join(f"{r.check}: {r.failures} ({r.example})" for r in bad))
