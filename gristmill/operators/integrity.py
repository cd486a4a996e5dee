"""Key and matrix checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_cells(rows: DataFrame, dims: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Cells of the full matrix (the cross product of the dims' values, or `expected`) without a row."""
    if expected is None:
        expected = reduce(lambda a, b: a.crossJoin(b), [rows.select(d).distinct() for d in dims])
    return expected.join(rows.select(*dims), dims, "left_anti")


def extra_cells(rows: DataFrame, dims: list[str], expected: DataFrame) -> DataFrame:
    """Keys of rows that the matrix doesn't have."""
    return rows.select(*dims).distinct().join(expected, dims, "left_anti")


def require_complete(rows: DataFrame, dims: list[str], expected: DataFrame) -> DataFrame:
    """Rows as they are; raises where a cell is missing, extra or double."""
    for what, bad in (("missing", missing_cells(rows, dims, expected)), ("extra", extra_cells(rows, dims, expected)), ("double", rows.groupBy(*dims).count().where("count > 1"))):
        first = bad.first()
        if first is not None:
            raise ValueError(f"{what} cell: {first}")
    return rows


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a result yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def mandatory(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A lookup that must match; a row without one fails the query."""
    found = rows.join(lookup.withColumn("_found", F.lit(True)), keys, "left")
    return found.withColumn(value, F.when(F.col("_found").isNull(), F.raise_error(F.lit("no match in the lookup"))).otherwise(F.col(value))).drop("_found")


def inconsistent(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that only one side has, or whose columns differ; nulls are equal to nulls."""
    x = a.select(*keys, F.struct(*columns).alias("x"), F.lit(True).alias("in_x"))
    y = b.select(*keys, F.struct(*columns).alias("y"), F.lit(True).alias("in_y"))
    both = x.join(y, keys, "full")
    side = F.when(F.col("in_y").isNull(), "left only").when(F.col("in_x").isNull(), "right only").otherwise("differs")
    return both.where(F.col("in_x").isNull() | F.col("in_y").isNull() | ~F.col("x").eqNullSafe(F.col("y"))).select(*keys, side.alias("problem"))


def stable_key(*parts: Column) -> Column:
    """The hash of the parts as a JSON list of strings without quotes or backslashes in them."""
    return F.sha2(F.concat(F.lit('["'), F.concat_ws('","', *parts), F.lit('"]')), 256)


def flatten_summaries(rows: DataFrame, metrics: str, fields: list[str]) -> DataFrame:
    """P25: a column map<name, struct<value, ...>> as columns: the value under the name, other fields under name_field."""
    names = [r[0] for r in rows.select(F.explode(F.map_keys(metrics))).distinct().orderBy("col").collect()]
    flat = [F.col(metrics)[n][f].alias(n if f == "value" else f"{n}_{f}") for n in names for f in fields]
    return rows.select(*[c for c in rows.columns if c != metrics], *flat)


def audit(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Counts of all tables against what is expected."""
    counts = reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).withColumn("name", F.lit(name)) for name, t in tables.items()])
    want = F.create_map(*[F.lit(x) for item in expected.items() for x in item])
    return counts.select("name", "rows", want[F.col("name")].cast("long").alias("expected"), (F.col("rows") == want[F.col("name")]).alias("complete"))
