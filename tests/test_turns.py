"""Files hashed in turns against hashlib."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from gristmill.sources import inventory

try:
    from gristmill.sources import turns
except ImportError:  # before there were turns
    turns = None

R = random.Random(5)
MARK = b"\xef\xbb\xbf"
BODY = R.randbytes(90_000)
FILES = {
    "random": BODY,
    "with space": R.randbytes(40_000),
    "feed at end": BODY[:50_000] + b"\n",
    "feeds at end": BODY[:50_000] + b"\n\n\n",
    "mark": MARK + BODY[:30_001],
    "mark and feed": MARK + b"x" * 30_000 + b"\n",
    "marks": MARK + MARK + BODY[:20_000] + MARK,
    "only feeds": b"\n" * 20_000,
    "no feed": b"\0" * 300_000,
    "returns": b"a\r\nb\r" * 9_000,
    "rows": b"".join(b"%d,row\n" % i for i in range(8_000)),
    "packed.gz": BODY[:33_333],
    "small": b"a\nb",
    "mark alone": MARK,
}


@pytest.fixture
def small_turns(spark, monkeypatch):
    if turns:
        monkeypatch.setattr(turns, "TURN", 16_384)
    own = {"spark.sql.files.maxPartitionBytes": "7000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(folder, names):
    for n in names:
        (folder / n).write_bytes(FILES[n])
    return {(n, len(FILES[n]), hashlib.sha256(FILES[n]).hexdigest()) for n in names}


def test_odd_files(spark, tmp_path, small_turns):
    (tmp_path / "in %41 it").mkdir()
    want = written(tmp_path / "in %41 it", FILES)
    got = inventory.files(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.path.rsplit("/", 1)[1], r.bytes, r.sha256) for r in got} == want
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path")
    assert {r.path for r in got} == {r.path for r in plain.collect()}


def test_more_than_one_value_holds(spark, tmp_path, small_turns):
    """Spark refuses a value above this setting, 2 GB unless it is lowered."""
    want = written(tmp_path, ["random", "rows", "small"])
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "20000")
    try:
        got = inventory.files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {(r.path.rsplit("/", 1)[1], r.bytes, r.sha256) for r in got} == want


def test_turns_are_bounded(spark, tmp_path):
    """No turn of a file has much more than its bytes, and turns follow one another."""
    (tmp_path / "f").write_bytes(BODY)
    turn, at = 16_384, 0
    lines = BODY.split(b"\n")
    splits, start = [], 0
    for i in range(0, len(BODY), 30_000):  # as Hadoop deals lines out: those that begin after a split's start, up to its end
        split, end = [], min(i + 30_000, len(BODY))
        while lines and (start <= end):
            split.append(lines.pop(0))
            start += len(split[-1]) + 1
        splits.append((i, end - i, split))
    rows = [(x, "f", i, n) for i, n, split in splits for x in split]
    sent = spark.createDataFrame(rows, "value binary, file string, start long, length long").coalesce(1)
    got = sent.mapInArrow(lambda batches: turns._pieces(batches, turn), turns.PIECES).orderBy("start", "seq").collect()
    assert b"".join(bytes(r.piece) for r in got) == BODY + b"\n"
    assert [r.turn for r in got] == sorted(r.turn for r in got)


def test_a_file_that_changes_is_told(spark, tmp_path):
    lines = spark.createDataFrame([(b"abc", "f", 0, 9)], "value binary, file string, start long, length long")
    large = spark.createDataFrame([("f", "f", 9)], "file string, path string, bytes long")
    with pytest.raises(Exception, match="changed while it was read: f"):
        turns.hashed(large, lines, 4).collect()


def test_pieces_are_gone(spark, tmp_path, small_turns):
    from gristmill import shared_dir

    written(tmp_path, ["random"])
    inventory.files(spark, str(tmp_path)).where(F.col("bytes") > 0).collect()
    for top, folders, _ in os.walk(shared_dir(spark).removeprefix("file://")):
        assert "pieces" not in folders, top
