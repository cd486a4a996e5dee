"""Line-delimited JSON with row hashes, keyed appends and write-once files."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH = "row_sha256"


def canonical(columns: dict[str, Column], strings: set[str]) -> Column:
    """S3: JSON text with sorted keys and without spaces; null as null.

    Of strings, numbers that print alike everywhere (integers, booleans) and JSON texts already made. Doubles must be given as
    formatted strings, because engines print them differently.
    """
    escape = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'^\{"x":|\}$', "")
    parts = []
    for i, name in enumerate(sorted(columns)):
        c = columns[name]
        value = F.when(c.isNull(), "null").otherwise(escape(c) if name in strings else c.cast("string"))
        parts += [F.lit(("," if i else "") + json.dumps(name, ensure_ascii=False) + ":"), value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON of the columns, the hash itself left out."""
    names = [c for c in columns or df.columns if c != HASH]
    kinds = {f.name: f.dataType for f in df.schema}
    odd = [c for c in names if isinstance(kinds[c], (T.DoubleType, T.FloatType, T.TimestampType, T.TimestampNTZType))]
    if odd:
        raise ValueError(f"format these columns as text before hashing: {odd}")
    return F.sha2(canonical({c: F.col(c) for c in names}, {c for c in names if isinstance(kinds[c], T.StringType)}), 256)


def with_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumn(HASH, row_hash(df, columns))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, verify: bool = True) -> DataFrame:
    """Blank lines are skipped; where the schema has a row hash, a row of another content fails the query."""
    rows = spark.read.schema(schema).json(path)
    if not verify or HASH not in rows.columns:
        return rows
    wrong = F.col(HASH).isNotNull() & (row_hash(rows) != F.col(HASH))
    return rows.withColumn(HASH, F.when(wrong, F.raise_error(F.concat(F.lit("row hash differs: "), F.col(HASH)))).otherwise(F.col(HASH)))


def classify_append(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` with the status of each row against what is stored: append, skip (equal) or conflict (same key, other content)."""
    old = existing.select(*keys, F.col(HASH).alias("stored"))
    status = F.when(F.col("stored").isNull(), "append").when(F.col("stored") == F.col(HASH), "skip").otherwise("conflict")
    return new.join(old, keys, "left").withColumn("status", status).drop("stored")


class KeyedStore:
    """An append-only table at `path`, one row for each key.

    Rows equal to stored ones are skipped; a conflict, or a key that comes twice with different contents, stops the append
    before anything is written.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def exists(self) -> bool:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        if not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError(f"duplicate keys in {self.path}")
        return rows

    def append(self, rows: DataFrame) -> dict[str, int]:
        new = with_hash(rows)
        twice = new.groupBy(*self.keys).agg(F.min(HASH).alias("a"), F.max(HASH).alias("b")).where("a <> b")
        if not twice.isEmpty():
            raise ValueError(f"a key comes with different contents: {twice.select(*self.keys).first()}")
        new = new.dropDuplicates(self.keys)
        if not self.exists():
            new.write.parquet(self.path)
            return {"append": new.count(), "skip": 0}
        told = classify_append(self.read(), new, self.keys).persist()
        try:
            counts = {r["status"]: r["count"] for r in told.groupBy("status").count().collect()}
            if counts.get("conflict"):
                raise ValueError(f"{counts['conflict']} rows conflict with stored ones")
            told.where("status = 'append'").drop("status").write.mode("append").parquet(self.path)
            return {"append": counts.get("append", 0), "skip": counts.get("skip", 0)}
        finally:
            told.unpersist()


def write_once(df: DataFrame, path: str) -> None:
    """JSON lines; fails where the path exists."""
    df.write.mode("errorifexists").json(path)


def canonical_text(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def write_json_once(path: Path, value: object) -> None:
    """A driver-side manifest; written again only with an equal value."""
    if path.exists():
        if canonical_text(json.loads(path.read_text("utf-8"))) != canonical_text(value):
            raise RuntimeError(f"{path} has another value")
        return
    write_json(path, value)


def write_json(path: Path, value: object) -> None:
    """Through a neighbouring file and a rename, so that a reader never sees half of it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(path.name + ".part")
    beside.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", "utf-8")
    beside.replace(path)


def sha256_of(value: object) -> str:
    return hashlib.sha256(canonical_text(value).encode()).hexdigest()
