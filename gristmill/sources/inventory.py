"""File identity: hashes, inventories, manifests, archives, CSV tables and text scans."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import tarfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import importable
from gristmill.sources import turns

SHA256, COMMIT = "^[0-9a-f]{64}$", "^[0-9a-f]{40}$"
# Fields that a public table must not have.
PRIVATE = ("question_id", "question", "reference_answers", "relevant_document_ids", "text", "context", "packed_context", "raw_output", "normalized_output", "top_k", "candidate_ranking")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of all files below `path`; contents are hashed on the executors.

    Files above `turns.TURN` bytes are hashed in turns, before this returns. Those whose names Spark's reader of lines takes
    for packed ones are hashed as one value, as the small ones are, and so are all where OpenSSL's library is missing; that
    holds up to 2 GB, where Spark refuses a value.
    """
    importable(spark)
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    found = read.format("binaryFile").load(path)
    hashes = ["path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")]
    large = found.where(turns.cut(turns.TURN)).select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("bytes"))
    if not turns.possible() or large.isEmpty():
        return found.select(*hashes)
    lines = read.option("lineSep", "\n").text(path).where(turns.cut(turns.TURN))
    lines = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"))
    return found.where(~turns.cut(turns.TURN)).select(*hashes).unionByName(turns.hashed(large, lines, turns.TURN))


def tree_hash(inventory: DataFrame) -> DataFrame:
    """One hash of the sorted inventory, with the number of files and bytes."""
    line = F.concat_ws("|", F.element_at(F.split("path", "/"), -1), F.col("bytes").cast("string"), "sha256")
    return inventory.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("tree_sha256"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def identity_failures(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Manifest rows (name, sha256) whose file is missing or differs."""
    o = observed.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("observed"))
    return expected.join(o, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("observed")))


def is_sha256(c: Column) -> Column:
    """P17."""
    return F.coalesce(c.rlike(SHA256), F.lit(False))


def is_commit(c: Column) -> Column:
    return F.coalesce(c.rlike(COMMIT), F.lit(False))


def member_by_hash(archive: bytes, sha256: str) -> bytes:
    """The ZIP member whose content has the hash; there must be one."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        found = [data for name in z.namelist() if not name.endswith("/") and hashlib.sha256(data := z.read(name)).hexdigest() == sha256]
    if len(found) != 1:
        raise RuntimeError(f"{len(found)} members have the hash {sha256}")
    return found[0]


def archive_mismatches(archive: Path, expected: dict[str, str]) -> list[str]:
    """Names of `expected` (suffix of a path in a tar archive: sha256) that aren't there once with that content."""
    have: dict[str, list[str]] = {}
    with tarfile.open(archive) as t:
        for m in t.getmembers():
            if m.isfile():
                have.setdefault(m.name, []).append(hashlib.sha256(t.extractfile(m).read()).hexdigest())
    wrong = []
    for suffix, sha in expected.items():
        hits = [h for name, hs in have.items() if name == suffix or name.endswith("/" + suffix) for h in hs]
        if hits != [sha]:
            wrong.append(suffix)
    return wrong


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; a row of another width fails the query."""
    with_header = spark.read.option("header", "true").csv(path)
    return spark.read.schema(with_header.schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def html_report(tables: dict[str, str], title: str) -> str:
    """CSV texts by name as an HTML page; a ragged or empty table is refused."""
    parts = []
    for name, text in sorted(tables.items()):
        rows = list(csv.reader(io.StringIO(text)))
        if not rows or any(len(r) != len(rows[0]) for r in rows):
            raise ValueError(f"malformed table {name}")
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
        parts.append(f"<h2>{html.escape(name)}</h2><table>{row(rows[0], 'th')}{''.join(row(r, 'td') for r in rows[1:])}</table>")
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{"".join(parts)}</html>'


def private_fields(schema: T.StructType, fields: tuple[str, ...] = PRIVATE) -> list[str]:
    """Paths of protected fields anywhere in a schema."""
    found: list[str] = []

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                here = f"{at}.{f.name}" if at else f.name
                if f.name in fields:
                    found.append(here)
                walk(f.dataType, here)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, at + "[]")
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, at + "{}")

    walk(schema, "")
    return sorted(found)


def scan_lines(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """`rows` with line_number (from 1) and line of each line that matches."""
    lines = rows.select("*", F.posexplode(F.split(text, "\n")).alias("line_number", "line"))
    return lines.where(F.col("line").rlike(pattern)).withColumn("line_number", F.col("line_number") + 1)
