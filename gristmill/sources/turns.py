"""SHA-256 of files in turns (S8): a task reads a stretch of a file and hands the hash's state on, none reads the whole file.

Spark's only reader that splits any file is the one of lines. Its lines are cut at line feeds alone, as bytes; joined again
they are the file, but for a mark of UTF-8 before the first and a line feed after the last, which the file's size tells.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib  # loads OpenSSL's library where Python has one of its own
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import shared_dir

#: Bytes of a file that one task hashes. Smaller files are not cut.
TURN = 64 << 20
#: Bytes of a row at most, and of what a writer or a reader of pieces holds, about: Parquet's own bounds suit small rows.
PIECE, HELD = 1 << 17, 1 << 23
SMALL = {"parquet.block.size": str(HELD), "parquet.block.size.row.check.min": "8", "parquet.page.size.row.check.min": "8"}
#: Hadoop's reader of lines unpacks files with these names.
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
MARK = b"\xef\xbb\xbf"
PIECES = "file string, turn int, start long, seq int, size long, piece binary"
STATES = "file string, path string, bytes long, rest long, state binary, sha256 string"
_CONTEXT = 112  # bytes of OpenSSL's SHA256_CTX


@functools.cache
def _crypto() -> ctypes.CDLL | None:
    for name in ("libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.3.dylib"):
        try:
            lib = ctypes.CDLL(name)
            lib.SHA256_Init.argtypes = [ctypes.c_void_p]
            lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            lib.SHA256_Final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
            return lib
        except (OSError, AttributeError):
            pass
    return None


class Sha256:
    """SHA-256 that goes on from a state; hashlib keeps its own to itself."""

    def __init__(self, state: bytes | None = None) -> None:
        if not (lib := _crypto()):
            raise RuntimeError("OpenSSL's libcrypto is not on this machine")
        self._lib, self._own = lib, ctypes.create_string_buffer(state or b"", _CONTEXT)
        if not state:
            lib.SHA256_Init(self._own)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._own, data, len(data))

    def state(self) -> bytes:
        return self._own.raw

    def hexdigest(self) -> str:
        end = ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(end, ctypes.create_string_buffer(self._own.raw, _CONTEXT))
        return end.raw.hex()


@functools.cache
def possible() -> bool:
    """Whether this machine's OpenSSL hands states on, and hashes as hashlib does."""
    if not _crypto():
        return False
    first = Sha256()
    first.update(b"a" * 100)
    second = Sha256(first.state())
    second.update(b"b" * 100)
    return second.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()


def cut(turn: int) -> Column:
    """Of a file source: whether a file goes in turns. Of the file's own fields alone, so that others are not opened."""
    return (F.col("_metadata.file_size") > turn) & ~F.col("_metadata.file_name").rlike(PACKED)


def _pieces(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, start, length) in order, with the split they are in, as pieces of their file.

    A piece's turn follows from where it is, roughly: it never falls within a file, and no turn has much more than its bytes.
    """
    at, done, seq = None, 0, 0
    for batch in batches:
        value, file, start, length = batch.columns
        name, begins = np.asarray(file.dictionary_encode().indices), np.asarray(start)
        edges = np.flatnonzero((np.diff(name) != 0) | (np.diff(begins) != 0)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if i == j:
                continue
            if at != (split := (file[i].as_py(), start[i].as_py())):
                at, done, seq = split, 0, 0
            last = split[1] + length[i].as_py() - 1
            lines = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), value.slice(i, j - i))
            data = pc.binary_join(lines, b"\n")[0].as_py() + b"\n"
            out = []
            for k in range(0, len(data), PIECE):
                piece = data[k : k + PIECE]
                out.append((split[0], min(split[1] + done, last) // turn, split[1], seq, len(piece), piece))
                done, seq = done + len(piece), seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["file", "turn", "start", "seq", "size", "piece"])


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's state, then its pieces in order: the state after them."""
    own = sha = None

    def told() -> pa.RecordBatch:
        row = [*own, sha.state(), sha.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["file", "path", "bytes", "rest", "state", "sha256"])

    for batch in batches:
        for file, start, piece, path, size, rest, state in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "piece", "path", "bytes", "rest", "state"))):
            if start < 0:
                if own:
                    yield told()
                own, sha = [file, path, size, rest], Sha256(state)
            elif not own or own[0] != file:
                raise RuntimeError(f"no state of {file}")
            piece = piece[: own[3]]  # what goes beyond is a line feed that the file has not
            sha.update(piece)
            own[3] -= len(piece)
    if own:
        yield told()


def hashed(large: DataFrame, lines: DataFrame, turn: int) -> DataFrame:
    """(path, bytes, sha256) of the files `large` (file, path, bytes), from their `lines` (value, file, start, length).

    The pieces are written once to the shared folder; then each turn is a job with a task for each file, which takes the
    state on. They are gone when this returns.
    """
    spark = lines.sparkSession
    folder = f"{shared_dir(spark)}/gristmill/turns-{uuid.uuid4().hex}"
    try:
        lines.mapInArrow(lambda batches: _pieces(batches, turn), PIECES).write.options(**SMALL).partitionBy("turn").parquet(f"{folder}/pieces")
        pieces = spark.read.schema(PIECES).parquet(f"{folder}/pieces")
        sizes = pieces.groupBy("file").agg(F.sum("size").alias("size"))
        lost = F.col("bytes") - F.col("size")
        wrong = F.raise_error(F.concat(F.lit("changed while it was read: "), "path"))
        mark = F.when(lost.isin(-1, 0), F.lit(b"")).when(lost.isin(2, 3), F.lit(MARK)).otherwise(wrong.cast("binary"))
        state = large.join(sizes, "file", "left").select("file", "path", "bytes", F.col("bytes").alias("rest"), F.lit(None).cast("binary").alias("state"), mark.alias("piece"))
        tasks = 2 * large.count()
        for n in sorted(r.turn for r in pieces.select("turn").distinct().collect()):
            first = state.withColumns({"start": F.lit(-1).cast("long"), "seq": F.lit(-1)})
            rows = first.unionByName(pieces.where(F.col("turn") == n).select("file", "start", "seq", "piece"), allowMissingColumns=True)
            rows.repartition(tasks, "file").sortWithinPartitions("file", "start", "seq").mapInArrow(_advance, STATES).write.parquet(f"{folder}/state-{n}")
            state = spark.read.schema(STATES).parquet(f"{folder}/state-{n}").withColumn("piece", F.lit(b""))
        return state.select("path", "bytes", F.when(F.col("rest") == 0, F.col("sha256")).otherwise(wrong.cast("string")).alias("sha256"))
    finally:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pieces")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
