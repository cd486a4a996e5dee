"""Packing by concatenate and cut.

Documents stand one after the other, each followed by the id END, and the run of ids is cut into windows of `length`.
Texts are encoded once: a task writes the ids of its documents with the number of ids before each in the task, and the
totals of all tasks are summed up before each task in a second pass, which reads no ids.  The two together are the place
of every document in the whole run, so that its pieces and their boundary records follow without a shuffle of ids or
texts.  Only the last sequence can be shorter than `length`.

Ids are those of the `tokenizers` library with special tokens' strings taken as ordinary text.  A match of a byte-level
vocabulary never crosses a space that stands before something else than white space, so texts are cut there and every
distinct word of a run of texts is encoded once.  Where the file's merges are its ids in order, words of common letters
go through a faster library with the same merges; all others, such as other scripts, go through `tokenizers` itself.

Edge cases: a null or empty text is the id END alone; texts of any length are cut whole; repeated rows and equal ids are
packed once for each row; a null id stays null; an empty table gives an empty result; further columns are left out.
Documents stand in the order in which the scan deals them out, which no result beside the places depends on.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm.common import map_arrow, materialise, read, schema_of

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 1024
#: The id after each document.
END = 0
#: Bytes of text that are encoded together, and distinct words that a worker holds.
CHUNK, HELD = 8 << 20, 300_000
#: Tasks whose totals are summed in one window.
BLOCK = 1024
#: A space before white space or the end: words of such texts aren't looked up.
_ODD = r" (?:[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]|\z)"
#: Characters that libraries of other Unicode versions might tell apart otherwise.
_RARE = re.compile("[\x1c-\x1f\x85\xa0ɐ-\U0010ffff]").search


class Encoder:
    """Ids of whole texts, word by word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            self._start(lines.read())

    def _start(self, serialised: str) -> None:
        self.tokenizer = Tokenizer.from_str(serialised)
        self.tokenizer.encode_special_tokens = True
        self.quick = self._same_merges(json.loads(serialised)["model"])
        self.space = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.space[[i for t, i in self.tokenizer.get_vocab(False).items() if t.startswith("Ġ")]] = True
        self.known: dict[str, int] = {}
        self.ids, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)

    @staticmethod
    def _same_merges(model: dict) -> tiktoken.Encoding | None:
        """The vocabulary as ranks, if the merges make the ids after the single bytes one after the other."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ordered = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and {vocab.get(c) for c in byte} == set(range(256))
        if not ordered or model.get("ignore_merges") or model.get("unk_token") or model.get("dropout"):
            return None
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _each(self, texts: list[str]) -> list[list[int]]:
        out: list = [self.quick.encode_ordinary(t) if self.quick and not _RARE(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after a space, one after the other, and the number of ids of each."""
        text = " " + " ".join(words) if words else ""
        if self.quick and not _RARE(text):  # words hold no space, so that each begins with the next id that starts with one
            flat = np.array(self.quick.encode_ordinary(text), np.uint32)
            return flat, np.diff(np.append(np.flatnonzero(self.space[flat]), len(flat)))
        ids: list = [[] for _ in words]
        common = [i for i, w in enumerate(words) if self.quick and not _RARE(w)]
        rare = [i for i, w in enumerate(words) if not self.quick or _RARE(w)]
        if common:
            flat, lengths = self._words([words[i] for i in common])
            for i, x in zip(common, np.split(flat, np.cumsum(lengths)[:-1])):
                ids[i] = x.tolist()
        for i, e in zip(rare, self.tokenizer.encode_batch([" " + words[i] for i in rare], add_special_tokens=False)):
            ids[i] = e.ids
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _look_up(self, words: list[str], often: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(place of each word, ids, lengths): the held words, then those that are new; what a run has `often` is held."""
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(places < 0)
        new = np.concatenate([new[often[new]], new[~often[new]]])
        held = len(self.lengths)
        ids, lengths = self._words([words[i] for i in new])
        places[new] = held + np.arange(len(new), dtype=np.int32)
        keep = min(int(often[new].sum()), max(0, HELD - held))
        before = self.ids, self.lengths
        if keep:
            self.known.update((words[i], held + n) for n, i in enumerate(new[:keep].tolist()))
            self.lengths = np.concatenate([self.lengths, lengths[:keep]])
            self.ids = np.concatenate([self.ids, ids[: int(lengths[:keep].sum())]])
        return places, [before[0], ids], [before[1], lengths]

    def encode(self, texts: pa.Array, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each), with `end` after each text."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = {}
        if odd := np.flatnonzero(pc.match_substring_regex(texts, _ODD)).tolist():
            whole = {i: texts[i].as_py() for i in odd}
            texts = pc.if_else(pa.array(np.isin(np.arange(n), odd)), "", texts)
        lists = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(lists).to_numpy()
        first = np.cumsum(sizes) - sizes
        coded = lists.flatten().dictionary_encode()
        indices = coded.indices.to_numpy()
        places, ids, lengths = self._look_up(coded.dictionary.to_pylist(), np.bincount(indices, minlength=len(coded.dictionary)) > 1)
        words = places[indices]
        # texts' first words stand after no space; texts that aren't cut stand as one word
        heads = coded.dictionary.take(coded.indices.take(pa.array(first))).to_pylist()
        more = self._each([whole.get(i, t) for i, t in enumerate(heads)])
        known = sum(map(len, lengths))
        words[first] = known + np.arange(n)
        ids.append(np.fromiter(chain.from_iterable(more), np.uint32))
        lengths.append(np.fromiter(map(len, more), np.int64, n))
        if end is not None:
            words = np.insert(words, first + sizes, known + n)
            sizes, first = sizes + 1, first + np.arange(n)
            ids.append(np.array([end], np.uint32))
            lengths.append(np.ones(1, np.int64))
        ends = np.append(0, np.cumsum(np.concatenate(lengths)) * 4).astype(np.int32)
        store = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(ids))])
        laid = store.take(pa.array(words))
        ends = np.frombuffer(laid.buffers()[1], np.int32, len(laid) + 1) // 4
        return np.frombuffer(laid.buffers()[2], "<u4", int(ends[-1])), np.diff(np.append(ends[first], ends[-1])).astype(np.int64)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def _runs(batches, most: int):
    """(doc_id, text) arrays of about `most` bytes of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= most:
            yield from _parts(held, most)
            held, size = [], 0
    if held:
        yield from _parts(held, most)


def _parts(batches: list, most: int):
    t = pa.Table.from_batches(batches).combine_chunks()
    if not t.num_rows:
        return
    ids, texts = (c.chunk(0) for c in t.columns)
    run = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // most
    cuts = np.flatnonzero(np.diff(run)) + 1
    for i, j in zip(np.append(0, cuts), np.append(cuts, len(run))):
        yield ids.slice(i, j - i), texts.slice(i, j - i)


ENCODED = "part int, before long, doc_id long, doc_tokens long, ids binary"


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(part, before, doc_id, doc_tokens, ids): of each document its ids with END, as little-endian unsigned 32-bit numbers,
    its task, and the number of ids before it in that task."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        own, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for ids, texts in _runs(batches, CHUNK):
            flat, sizes = own.encode(texts)
            ends = np.cumsum(sizes)
            offsets = np.append(0, ends * 4).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(before + ends - sizes), ids, pa.array(sizes), packed], names=["part", "before", "doc_id", "doc_tokens", "ids"]
            )
            before += int(ends[-1])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(d, run, schema_of(ENCODED))


def offsets(totals: DataFrame) -> DataFrame:
    """(part, ahead): the number of ids of all tasks before each, from (part, tokens)."""
    t = totals.withColumn("block", F.floor(F.col("part") / BLOCK))
    up_to = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = t.groupBy("block").agg(F.sum("tokens").alias("tokens")).select("block", F.coalesce(F.sum("tokens").over(up_to), F.lit(0)).alias("ahead_of_block"))
    inside = W.partitionBy("block").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("in_block", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return t.join(blocks, "block").select("part", (F.col("ahead_of_block") + F.col("in_block")).alias("ahead"))


def pieces(encoded: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of encoded documents: a row for each piece of each.

    The places of tasks are a row for each task that encoded, which the driver's scheduler holds itself: they are broadcast.
    """
    ahead = offsets(encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")))
    place = F.col("before") + F.col("ahead")
    e = encoded.join(F.broadcast(ahead), "part").select("doc_id", "doc_tokens", "ids", place.alias("place"))
    n = F.lit(length).cast("long")
    window = F.expr(f"place div {length}")

    def piece(w):
        start = F.greatest(w * n, F.col("place"))
        size = F.least((w + 1) * n, F.col("place") + F.col("doc_tokens")) - start
        own = start - F.col("place")
        return F.struct(own.alias("start"), size.alias("length"), F.substring("ids", (own * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"), w.alias("sequence_id"), (start - w * n).alias("offset"))

    cut = F.transform(F.sequence(window, F.expr(f"(place + doc_tokens - 1) div {length}")), piece)
    p = e.select("doc_id", "doc_tokens", F.explode(cut).alias("p"))
    return p.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The pieces of `docs` in sequences of `length` ids.  The encoded documents are written once to the shared folder."""
    if length < 1:
        raise ValueError("sequences hold at least one id")
    return pieces(materialise(encode(docs, path), "packed-ids", compression="zstd"), length)


def sequences(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids array<long>, padding, documents): the sequences whole, with a boundary record for each piece in
    them.  A sequence holds at most `length` pieces, so no group grows with the corpus."""
    record = F.struct("offset", "length", "doc_id", "start", F.hex("ids").alias("own"))
    g = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(record)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["own"]), "")
    number = lambda i: F.conv(F.concat(*[F.substring(text, i * 8 + 1 + k, F.lit(2)) for k in (6, 4, 2, 0)]), 16, 10).cast("long")  # noqa: E731  little-endian
    count = F.expr("length(array_join(transform(p, x -> x.own), '')) div 8")
    ids = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), number)
    return g.select("sequence_id", ids.alias("ids"), (F.lit(length) - count).alias("padding"), F.transform("p", lambda x: x.dropFields("own")).alias("documents"))


def query(spark, sf_dir):
    p = pack(read(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
