"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards.  A document descends it: at each level every child of the node reached draws
-ln(u) / weight with u a hash of the document's id and the child's path, and the smallest draw wins, so a child is
taken with a probability in proportion to its weight (a shard's own, or the sum of what stands below it).  When the
weight of a child grows, only its own draws shrink: documents move into that subtree and nowhere else.  `grow()` puts
the new shard into a region of its own, whose subtree is that shard alone, so the new shard is the only one to gain.

Edge cases: a null id draws as the text 'null'; a null text has 8 bytes and the checksum of the empty text; equal ids
go to the same shard; repeated rows keep a slot each; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm.common import documents, read


class Shard(NamedTuple):
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int = 24, racks: int = 3, per_rack: int = 4) -> list[Shard]:
    """`shards` equal shards in full racks and regions; what doesn't fill them comes last."""
    return [Shard(s, s // (racks * per_rack), s // per_rack % racks) for s in range(shards)]


def grow(leaves: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own."""
    return [*leaves, Shard(max((x.shard for x in leaves), default=-1) + 1, max((x.region for x in leaves), default=-1) + 1, 0, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def _choose(key: Column, parent: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(_draw(key, f"{parent}/{child}", w).alias("d"), F.lit(child).alias("c")) for child, w in sorted(weights.items())]
    return F.least(*draws)["c"]


def _switch(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


def place(df: DataFrame, key: Column, leaves: list[Shard], names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """`df` with the region, rack and shard that `key` (never null) descends to."""
    region, rack, shard = names
    total: dict[tuple, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for x in leaves:
        total[()][x.region] += x.weight
        total[(x.region,)][x.rack] += x.weight
        total[(x.region, x.rack)][x.shard] += x.weight
    df = df.withColumn(region, _choose(key, "", total[()]))
    df = df.withColumn(rack, _switch([(F.col(region) == r, _choose(key, f"/{r}", total[(r,)])) for r in sorted(total[()])]))
    return df.withColumn(shard, _switch([((F.col(region) == r) & (F.col(rack) == k), _choose(key, f"/{r}/{k}", v)) for (r, k), v in sorted((p, v) for p, v in total.items() if len(p) == 2)]))


def assign_shards(docs: DataFrame, leaves: list[Shard] | None = None, buckets: int = 1024) -> DataFrame:
    """A row for each document: its shard now and with one more shard, and its slot in the shard.

    Slots are gapless: documents are numbered within a hash bucket of the shard and moved by the count of the buckets
    before it.  Bucket counts come from a scan of the ids alone and are at most shards x `buckets` rows, which bounds
    the broadcast; no task holds a whole shard.
    """
    leaves = leaves or tree()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bucket = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int")
    d = documents(docs)
    counts = place(d.select("doc_id"), key, leaves).withColumn("bucket", bucket).groupBy("shard", "bucket").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))
    raw = F.col("text").cast("binary")
    rows = d.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = place(rows, key, leaves)
    rows = place(rows, key, grow(leaves), ("grown_region", "grown_rack", "grown_shard")).withColumn("bucket", bucket)
    slot = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("place", slot)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"), "region", "rack")
    )


def query(spark, sf_dir):
    return assign_shards(read(spark, sf_dir, "documents"))
