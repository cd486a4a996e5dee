"""Benchmark decontamination by SimHash windows.

Words are lower case, ASCII punctuation as space; shingles are 5 words (fewer in a shorter item).  For each size that items
have, the windows of a text are its runs of as many shingles; a text that is shorter is one window.  Windows without a shingle
of any item can be similar to none and are passed over.  Of the others the 64-bit SimHash is taken, from signs summed over the
shingles.  A fingerprint is cut into BLOCKS blocks; an item within RADIUS bits of a window differs in one of the blocks by
RADIUS // BLOCKS bits at most, so looking up each block's value in the table of the items near it finds every item of this
size within the radius, and nothing else proposes items.  Those are verified: similarity is the weighted Jaccard of the
shingle multisets, sum of minima over sum of maxima, where a shingle of the item weighs log(1 + items / items that hold it),
counted over the whole benchmark, and any other as if one item held it.

At a Jaccard similarity of 0.8 fingerprints differ in 10 bits on average and the standard deviation is 3; RADIUS 22 is four of
them away.

Items are taken in blocks of ITEM_BLOCK, a stated query set against all texts, so what goes to the executors is bounded
whatever the benchmark's size; the answers don't depend on the blocks.

Edge cases: null and empty items match nothing; null and empty texts too; items with equal texts are reported each; of
windows with equal similarity the first is reported; repeated rows are reported each; empty tables give an empty
result; further columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import as_bytes, map_arrow, materialise, read, schema_of
from gristmill.llm.licenses import words_of

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 8, 22
ITEM_BLOCK = 5_000
CACHED, STEP = 300_000, 4096
SCHEMA = "doc_id long, item_id long, similarity double, hamming int, start_word int, end_word int"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> 64-bit hash; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], k: int, cache: Words) -> np.ndarray:
    """Hashes of each run of k words; of the whole sequence where it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * _MULTIPLIER + h[i : len(h) - k + 1 + i])
    return out


def signs(s: np.ndarray) -> np.ndarray:
    """A row of 64 numbers, 1 or -1, for each shingle."""
    return np.unpackbits(s.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


class Blocks:
    """Fingerprints, found by their blocks: all within the radius, in one lookup for many prints."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius, width = prints, radius, BITS // BLOCKS
        values = np.arange(1 << width)
        self.shifts, self.mask = [np.uint64(b * width) for b in range(BLOCKS)], np.uint64((1 << width) - 1)
        self.table = np.array([np.bitwise_count(values[:, None] ^ ((prints >> at) & self.mask).astype(np.int64)[None, :]) <= radius // BLOCKS for at in self.shifts])

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `prints`, place in the index, bits that differ) of all pairs within the radius, the closest first."""
        found = np.zeros((len(prints), len(self.prints)), bool)
        for own, at in zip(self.table, self.shifts):
            found |= own[((prints >> at) & self.mask).astype(np.int64)]
        w, i = np.nonzero(found)
        away = np.bitwise_count(prints[w] ^ self.prints[i])
        keep = away <= self.radius
        order = np.argsort(away[keep], kind="stable")
        return w[keep][order], i[keep][order], away[keep][order]


class Item(NamedTuple):
    id: int
    words: int  # in a shingle: k, and fewer in an item shorter than that
    counts: Counter
    size: int
    weight: dict  # of its own shingles
    total: float


class Index:
    """The items of a block by words in a shingle and size, each size with its fingerprints by blocks."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, radius: int, holders: dict[int, int], total: int) -> None:
        self.unknown = math.log1p(total)
        self.groups: dict[int, dict[int, tuple[list[Item], Blocks]]] = defaultdict(dict)
        self.filters: dict[int, np.ndarray] = {}
        self.known: dict[int, np.ndarray] = {}
        held: dict[tuple[int, int], list[tuple[Item, np.ndarray]]] = defaultdict(list)
        cache = Words()
        for item, text in items:
            words = words_of(text)
            s = shingles(words, k, cache)
            if len(s):
                counts = Counter(s.tolist())
                weight = {x: math.log1p(total / holders.get(x, 1)) for x in counts}
                own = Item(item, min(k, len(words)), counts, len(s), weight, sum(weight[x] * c for x, c in counts.items()))
                held[own.words, own.size].append((own, s))
        for (n, size), group in sorted(held.items()):
            prints = pack(np.array([signs(s).sum(0) for _, s in group]))
            self.groups[n][size] = [own for own, _ in group], Blocks(prints, radius)
            self.known[n] = np.unique(np.concatenate([self.known.get(n, np.empty(0, np.uint64)), *(s for _, s in group)]))
        for n, known in self.known.items():
            self.filters[n] = np.zeros(1 << 20, bool)
            self.filters[n][(known >> np.uint64(44)).astype(np.int64)] = True

    def similarity(self, window: np.ndarray, item: Item) -> float:
        low, high = 0.0, item.total
        for s, x in Counter(window.tolist()).items():
            y = item.counts.get(s, 0)
            w = item.weight[s] if y else self.unknown
            low, high = low + w * min(x, y), high + w * max(0, x - y)
        return low / high

    def scan(self, words: list[bytes], cache: Words, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, bits that differ, first and last place) of the best window of each similar item."""
        out = []
        for n, sizes in self.groups.items():
            if len(words) < n:
                continue
            s = shingles(words, n, cache)
            hits = np.nonzero(self.filters[n][(s >> np.uint64(44)).astype(np.int64)])[0]
            known = self.known[n]
            hits = hits[known[np.minimum(np.searchsorted(known, s[hits]), len(known) - 1)] == s[hits]]
            if not len(hits):
                continue
            best: dict[int, tuple[float, int, int, Item]] = {}
            longest = min(max(sizes), len(s))
            for run in np.split(hits, np.nonzero(np.diff(hits) >= longest)[0] + 1):  # no window holds hits of two runs
                begin, end = max(0, int(run[0]) - longest + 1), min(int(run[-1]), len(s) - 1)
                for first in range(begin, end + 1, STEP):
                    self._best(s, first, min(first + STEP - 1, end), sizes, least, best)
            out += [(item.id, sim, away, at, at + min(item.size, len(s)) + n - 1) for sim, away, at, item in best.values()]
        return out

    def _best(self, s: np.ndarray, first: int, last: int, sizes: dict, least: float, best: dict) -> None:
        """Takes the windows that start at first to last into the best ones by item."""
        sums = np.zeros((min(len(s), last + max(sizes)) - first + 1, BITS), np.int32)
        np.cumsum(signs(s[first : first + len(sums) - 1]), axis=0, out=sums[1:])
        for size, (items, blocks) in sizes.items():
            own = min(size, len(s))
            windows = min(last, len(s) - own) - first + 1
            if windows <= 0:
                continue
            for j, i, away in zip(*(x.tolist() for x in blocks.near(pack(sums[own : own + windows] - sums[:windows])))):
                item, at = items[i], first + j
                held = best.get(id(item))
                if held and (held[0] == 1 and held[2] <= at):
                    continue
                sim = self.similarity(s[at : at + own], item)
                if sim >= least and (held is None or (sim, -at) > (held[0], -held[2])):
                    best[id(item)] = sim, away, at, item


def _shared_holders(rows: DataFrame, k: int) -> DataFrame:
    """(shingle, holders) of the shingles that two items or more hold, over the whole benchmark."""

    def run(batches):
        cache = Words()
        for b in batches:
            own = [np.unique(shingles(words_of(t), k, cache)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64))], names=["shingle"])

    return map_arrow(rows.select("text"), run, schema_of("shingle long")).groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")


def item_blocks(benchmark: DataFrame, k: int):
    """(items, holders, total) by block: lists of at most about ITEM_BLOCK (item_id, text), how many items of the whole benchmark
    hold those of their shingles that several hold, and how many items there are. Items are dealt out by hash where there is more
    than one block."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    total = rows.count()
    blocks = max(1, -(-total // ITEM_BLOCK))
    if blocks > 1:
        rows = materialise(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
        shared = materialise(_shared_holders(rows, k), "shingles")
    for block in range(blocks):
        part = rows.where(F.col("block") == block) if blocks > 1 else rows
        items, cache = [(r.item_id, bytes(r.text)) for r in part.select("item_id", "text").collect()], Words()
        own = [np.unique(shingles(words_of(text), k, cache)) for _, text in items]
        if blocks == 1:  # all items are here
            values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *own]), return_counts=True)
            holders = dict(zip(values[n > 1].tolist(), n[n > 1].tolist()))
        else:
            mine = benchmark.sparkSession.createDataFrame([(x,) for x in np.unique(np.concatenate([np.empty(0, np.uint64), *own])).view(np.int64).tolist()], "shingle long")
            holders = {r.shingle & (1 << 64) - 1: r.holders for r in shared.join(F.broadcast(mine), "shingle").collect()}
        yield items, holders, total


def _scanner(spark, block: tuple, least: float, k: int, radius: int):
    """Makes, on an executor, a function from a text to the items it holds."""
    sent = spark.sparkContext.broadcast(block)

    def make():
        items, holders, total = sent.value
        index, cache = Index(items, k, radius, holders, total), Words()
        return lambda text: index.scan(words_of(text), cache, least)

    return make


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """A row for each document and benchmark item that a window of it is similar to."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())

    def against(make):
        def run(batches):
            scan = make()
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[i], item, round(sim, 6), away, start, end) for i, text in enumerate(b.column(1).to_pylist()) for item, sim, away, start, end in scan(text)]
                cols = list(zip(*found)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=names)

        return map_arrow(as_bytes(docs), run, schema_of(SCHEMA))

    return reduce(DataFrame.unionByName, [against(_scanner(docs.sparkSession, items, similarity, k, radius)) for items in item_blocks(benchmark, k)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, with all their columns, no window of which is similar to an item."""
    at = docs.columns.index("text")

    def without(make):
        def run(batches):
            scan = make()
            for b in batches:
                yield b.filter(pa.array([not scan((t or "").encode()) for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    for items in item_blocks(benchmark, k):
        docs = map_arrow(docs, without(_scanner(docs.sparkSession, items, similarity, k, radius)), docs.schema)
    return docs


def query(spark, sf_dir):
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
