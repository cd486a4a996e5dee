"""Chunkers by sub-words (C1, C3-C9 with a tokenizer).

Cutting ids and decoding the pieces doesn't keep their number: a piece begins or ends inside a word or a character, is
trimmed, and encodes to fewer or more ids than it was cut from.  So no limit follows from the ids alone; a piece counts
as what its own text encodes to.  Plain windows are cut by Spark; what depends on the piece before (limits, packing,
breaks) is decided document by document on Arrow batches.

Texts have their white space trimmed; empty pieces are dropped and their index stays free.  Null texts have no chunks.
Where not even one id of a window decodes to a text that fits, such as white space alone, the window's ids are passed
over; `strict` raises instead.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import batched, chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import importable
from gristmill.functions.text import rule_sentences
from gristmill.functions.tokens import Tokenizer, decoded, token_count, token_ids
from gristmill.operators.chunking import CHUNK, cosine, fixed_windows, hashed_sentence_vector, recursive_split

#: Prefixes that are tried in one call of the tokenizer after the longest one, which mostly fits.
TRIED = 4


def _fitting(tokenizer: Tokenizer, ids: list[int], limit: int, strict: bool) -> tuple[str, int, int]:
    """(text, ids used, ids of the text) of C3."""
    most = min(limit, len(ids))
    for lengths in chain(batched([most][:most], 1), batched(range(most - 1, 0, -1), TRIED)):
        texts = [t.strip() for t in tokenizer.decode([ids[:n] for n in lengths])]
        fits = [(t, n, len(own)) for n, t, own in zip(lengths, texts, tokenizer.encode(texts)) if t and len(own) <= limit]
        if fits:
            return fits[0]
    if strict and ids:
        raise ValueError("no text of these ids fits the limit")
    return "", most, 0


def longest_prefix(tokenizer: Tokenizer, ids: list[int], limit: int, strict: bool = False) -> tuple[str, int]:
    """(text, ids used) of the longest run of ids from the start whose trimmed text encodes to `limit` ids at most.

    Lengths are tried from the longest down, since a shorter prefix may well encode to more ids than a longer one.
    """
    return _fitting(tokenizer, ids, limit, strict)[:2]


def _fitting_at_ends(tokenizer: Tokenizer, ids: list[int], limit: int, cuts: list[int]) -> tuple[str, int, int] | None:
    """The same for ids of a text that can be cut at `cuts`: what stands between the first and the last cut of a prefix
    keeps its ids, so the pieces at its ends alone are decoded and encoded. None where that isn't so or nothing is found."""
    head, i = "", 0
    while not head and i < len(cuts):  # a start of white space alone is trimmed with the space of the next piece
        head, i = tokenizer.decode([ids[: cuts[i]]])[0].lstrip() if cuts[i] else "", i + 1
    if not head:
        return None
    first, before = cuts[i - 1], len(tokenizer.encode([head])[0])
    for n in range(min(limit, len(ids)), first, -1):
        last = cuts[bisect_left(cuts, n) - 1]  # the last cut before the end, so that a piece follows
        tail = tokenizer.decode([ids[last:n]])[0].rstrip()
        count = before + last - first + len(tokenizer.encode([tail])[0])
        if count <= limit:
            return head + tokenizer.decode([ids[first:last]])[0] + tail, n, count
    return None


def _windows(tokenizer: Tokenizer, ids: list[int], size: int, overlap: int, strict: bool = False, encoded: bool = False) -> Iterator[tuple[str, int]]:
    """(text, its ids) of C5's windows; `encoded` says that the ids are those of a text."""
    known = tokenizer.starts() if encoded and hasattr(tokenizer, "starts") else ()
    cuts = [i for i, x in enumerate(ids) if x in known] if known else []
    start = 0
    while start < len(ids):
        part, found = ids[start : start + size], None
        if cuts:
            inside = [c - start for c in cuts[bisect_left(cuts, start) : bisect_left(cuts, start + size)]]
            found = _fitting_at_ends(tokenizer, part, size, inside)
        text, used, count = found or _fitting(tokenizer, part, size, strict)
        yield text, count
        if start + used == len(ids):
            return
        start += max(1, used - overlap)


def limited_windows(tokenizer: Tokenizer, ids: list[int], size: int, overlap: int, strict: bool = False) -> Iterator[str]:
    """C5 with a limit: each window is a longest prefix; the next one starts up to `overlap` ids before its end, and
    always after its start."""
    return (text for text, _ in _windows(tokenizer, ids, size, overlap, strict))


def windows_of(tokenizer: Tokenizer, text: str, size: int, overlap: int, strict: bool = False) -> Iterator[tuple[str, int]]:
    """C5 with a limit: (text, its ids) of the windows of a text."""
    return _windows(tokenizer, tokenizer.encode([text])[0], size, overlap, strict, True)


def limited_pieces(tokenizer: Tokenizer, text: str, size: int, strict: bool = False) -> Iterator[str]:
    """C4: windows without an overlap."""
    return (t for t, _ in windows_of(tokenizer, text, size, 0, strict))


def count_tables(tokenizer: Tokenizer, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each part its count at the start of a chunk, and after another part (a space stands before it)."""
    counts = np.array(list(map(len, tokenizer.encode([*parts, *(" " + p for p in parts)]))), np.int64)
    return counts[: len(parts)], counts[len(parts) :]


def packed(tokenizer: Tokenizer, parts: list[str], size: int, strict: bool = False) -> Iterator[str]:
    """Neighbours joined by a space while the joined text fits; a part beyond the size ends a chunk and is cut (C4).

    Where counts add up, the end of a chunk is looked up in their running sum; else every joined text is encoded.
    """
    first, after = count_tables(tokenizer, parts)
    up_to = np.append(0, np.cumsum(after))
    large = np.append(np.flatnonzero(first > size), len(parts))

    def end_of(start: int) -> int:
        stop = int(large[np.searchsorted(large, start)])
        if tokenizer.adds_up:  # what stands after the first part may take this much
            room = up_to[start + 1] + size - first[start]
            return min(stop, max(start + 1, int(np.searchsorted(up_to, room, "right")) - 1))
        end = start + 1
        while end < stop and len(tokenizer.encode([" ".join(parts[start : end + 1])])[0]) <= size:
            end += 1
        return end

    start = 0
    while start < len(parts):
        if first[start] > size:
            yield from limited_pieces(tokenizer, parts[start], size, strict)
            start += 1
        else:
            end = end_of(start)
            yield " ".join(parts[start:end])
            start = end


def broken(tokenizer: Tokenizer, parts: list[str], size: int, threshold: float, least: int, encode: Callable, similarity: Callable) -> Iterator[str]:
    """A chunk ends before a part that is unlike the one before it, once it has `least` ids, or that would pass the size.

    Counts are those of C8, added up.
    """
    first, after = count_tables(tokenizer, parts)
    up_to = np.append(0, np.cumsum(after))
    vectors = list(map(encode, parts))
    unlike = np.array([i for i, (a, b) in enumerate(pairwise(vectors), 1) if similarity(a, b) < threshold], int)
    start = 0
    while start < len(parts):
        own = first[start] - up_to[start + 1]  # with this, a running sum is the count of the chunk that ends there
        fit = max(start + 1, int(np.searchsorted(up_to, size - own, "right")) - 1)
        enough = start + 1 + int(np.searchsorted(up_to[start + 1 :], least - own, "left"))
        breaks = unlike[np.searchsorted(unlike, enough) :]
        end = min([fit, len(parts), *breaks[:1].tolist()])
        yield " ".join(parts[start:end])
        start = end


def _chunks(pieces: DataFrame, name: str, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, chunk_index, text) to chunk rows, with the count of each text."""
    p = pieces.where("text <> ''")
    return p.select(F.concat_ws("::", F.lit(name), "doc_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "text", token_count("text", tokenizer).alias("token_count"))


def _by_document(docs: DataFrame, prepared: Column, cut: Callable, name: str, tokenizer: Tokenizer) -> DataFrame:
    """Chunks that `cut` makes of `prepared`, a text or an array of each document: (text, number of its ids, or None where it isn't known)."""
    importable(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), prepared.alias("x")).where("x is not null")

    def run(batches):
        for b in batches:
            rows = [(d, i, t.strip(), n) for d, x in zip(b["doc_id"], b["x"]) for i, (t, n) in enumerate(cut(x)) if t.strip()]
            counts = iter(map(len, tokenizer.encode([t for _, _, t, n in rows if n is None])))
            yield pd.DataFrame([(f"{name}::{d}::{i}", d, i, t, next(counts) if n is None else n) for d, i, t, n in rows], columns=["chunk_id", "doc_id", "chunk_index", "text", "token_count"])

    return own.mapInPandas(run, CHUNK)


def fixed_chunks(docs: DataFrame, spec: dict, tokenizer: Tokenizer) -> DataFrame:
    size, overlap, strict = spec["size"], spec.get("overlap", 0), spec.get("strict", False)
    if spec.get("limit"):
        def cut(text):
            return windows_of(tokenizer, text, size, overlap, strict)

        return _by_document(docs, F.col("text"), cut, spec["name"], tokenizer)
    importable(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), token_ids("text", tokenizer).alias("ids")).where("ids is not null")
    windows = ids.select("doc_id", F.posexplode_outer(fixed_windows(F.col("ids"), size, overlap, "int")).alias("chunk_index", "window")).where("window is not null")
    text = F.regexp_replace(decoded("window", tokenizer), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return _chunks(windows.select("doc_id", "chunk_index", text.alias("text")), spec["name"], tokenizer)


def recursive_chunks(docs: DataFrame, spec: dict, tokenizer: Tokenizer) -> DataFrame:
    size, overlap = spec["size"], spec.get("overlap", 0)

    def cut(text):
        known: dict[str, int] = {}

        def length(t: str) -> int:
            if t not in known:
                known[t] = len(tokenizer.encode([t])[0])
            return known[t]

        for piece in recursive_split(text, size, overlap, length=length):
            yield from windows_of(tokenizer, piece, size, 0, spec.get("strict", False)) if spec.get("limit") else [(piece, None)]

    return _by_document(docs, F.col("text"), cut, spec["name"], tokenizer)


def sentence_chunks(docs: DataFrame, spec: dict, tokenizer: Tokenizer) -> DataFrame:
    return _by_document(docs, spec.get("split", rule_sentences)("text"), lambda s: ((t, None) for t in packed(tokenizer, list(s), spec["size"], spec.get("strict", False))), spec["name"], tokenizer)


def semantic_chunks(docs: DataFrame, spec: dict, tokenizer: Tokenizer) -> DataFrame:
    encode, similarity = spec.get("encode", hashed_sentence_vector), spec.get("similarity", cosine)
    least = spec.get("least") or max(32, spec["size"] // 2)
    return _by_document(docs, spec.get("split", rule_sentences)("text"), lambda s: ((t, None) for t in broken(tokenizer, list(s), spec["size"], spec["threshold"], least, encode, similarity)), spec["name"], tokenizer)


def sentence_counts(docs: DataFrame, tokenizer: Tokenizer, split: Callable = rule_sentences) -> DataFrame:
    """C8 as a table: (doc_id, position, sentence, first, continuation)."""
    importable(docs.sparkSession)
    s = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode_outer(split("text")).alias("position", "sentence")).where("sentence is not null")
    after = F.when(F.col("position") > 0, token_count(F.concat(F.lit(" "), "sentence"), tokenizer)).otherwise(0)
    return s.select("doc_id", "position", "sentence", token_count("sentence", tokenizer).alias("first"), after.alias("continuation"))


CHUNKERS: dict[str, Callable[[DataFrame, dict, Tokenizer], DataFrame]] = {"fixed": fixed_chunks, "recursive": recursive_chunks, "sentence": sentence_chunks, "semantic": semantic_chunks}
#: The frozen specifications, in order, with the limit held.
SPECS = [
    {"type": "fixed", "name": "fixed_128", "size": 128, "overlap": 19, "limit": True},
    {"type": "fixed", "name": "fixed_254", "size": 254, "overlap": 38, "limit": True},
    {"type": "recursive", "name": "recursive_254", "size": 254, "overlap": 38, "limit": True},
    {"type": "sentence", "name": "sentence_254", "size": 254, "limit": True},
]


def build_chunks(docs: DataFrame, spec: dict, tokenizer: Tokenizer) -> DataFrame:
    """C13 with a tokenizer."""
    if spec["type"] not in CHUNKERS:
        raise ValueError(f"unknown chunker type {spec['type']!r}")
    return CHUNKERS[spec["type"]](docs, spec, tokenizer)


def build_all(docs: DataFrame, tokenizer: Tokenizer, specs: list[dict] = SPECS) -> DataFrame:
    """The union over chunkers, with the chunker's name."""
    first, *others = [build_chunks(docs, s, tokenizer).withColumn("chunker", F.lit(s["name"])) for s in specs]
    for o in others:
        first = first.unionByName(o)
    return first
