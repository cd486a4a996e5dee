"""Byte-level BPE by a sentencepiece model made from the vocabulary.

Each token of the rank file becomes a piece, its bytes mapped to one letter each, with minus its rank as score, so that
the library's best-score-first merges are the vocabulary's merges in order; the normaliser is the identity.  Texts are
cut by the vocabulary's pattern, each match is encoded on its own (a match that is a token itself is that token), and
ids are decoded by the inverse mapping of pieces to bytes.

A match never crosses a space that stands before a character that isn't white space, so texts are first cut there and
what stands between is looked up in a bounded cache of encoded segments; texts with runs of white space after a space
are cut by the pattern itself.

Edge cases: a null or empty text has no tokens and decodes to no bytes; repeated rows get a row each; an empty table
gives an empty result; further columns are left out; any length is encoded whole.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import as_bytes, map_arrow, read, schema_of

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHED = 100_000
LONGEST = 100
CHUNK = 1 << 20
#: White space as the Unicode property has it.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = {b: chr(0x100 + b) for b in range(256)}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def piece_of(token: bytes) -> str:
    return token.decode("latin-1").translate(_LETTER)


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    head = varint(number << 3 | kind)
    return head + (varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model in protocol-buffer form; a token's id is its rank, the unknown piece comes last."""
    in_order = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in in_order] != list(range(len(in_order))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, 2, piece_of(t).encode()) + _field(2, 5, struct.pack("<f", -r)) + _field(3, 0, normal) for t, r in in_order]
    pieces.append(_field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, unknown))
    trainer = _field(3, 0, bpe) + _field(4, 0, len(pieces)) + _field(40, 0, len(in_order))
    normaliser = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
    return b"".join(_field(1, 2, p) for p in pieces) + _field(2, 2, trainer) + _field(3, 2, normaliser)


class _Held(dict):
    """Segment -> its ids.  A segment that isn't held gets an empty list, which is filled when all texts of a run are cut;
    the first CACHED segments, which have the frequent ones among them, are held for later runs."""

    def __init__(self) -> None:
        super().__init__()
        self.open: dict[str, list[int]] = {}

    def __missing__(self, key: str) -> list[int]:
        ids = self.open.get(key)
        if ids is None:
            ids = self.open[key] = []
            if len(self) < CACHED and len(key) < LONGEST:
                self[key] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = ranks_of(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.bytes = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.matches = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.odd = re.compile(r" (?:\s|\Z)").search
        self.held = {"": _Held(), " ": _Held()}

    def _cut(self, segment: str):
        """The matches of the pattern; letters alone, with a space before them or not, are one."""
        return (segment,) if segment[1:].isalpha() and (segment[0] == " " or segment[0].isalpha()) else self.matches(segment)

    def _merge(self, matches) -> dict[str, list[int]]:
        """The ids of each match: its own where it is a token, the others merged in one call of the library."""
        raw = {m: m.encode() for m in matches}
        known = {m: [rank] for m, b in raw.items() if (rank := self.ranks.get(b)) is not None}
        rest = [m for m in raw if m not in known]
        known.update(zip(rest, self.model.encode([piece_of(raw[m]) for m in rest], num_threads=1) if rest else []))
        return known

    def _fill(self) -> None:
        """The ids of all open segments."""
        for before, held in self.held.items():
            cut = [self._cut(before + w) if before or w else () for w in held.open]
            known = self._merge(m for matches in cut for m in matches)
            for ids, matches in zip(held.open.values(), cut):
                for m in matches:
                    ids += known[m]
            held.open = {}

    def segments(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text the ids of its segments in order."""
        first, after = self.held[""], self.held[" "]
        out = []
        try:
            for t in texts:
                if not t:
                    out.append([])
                elif self.odd(t):
                    out.append(list(map(first.__getitem__, self.matches(t))))
                else:
                    head, *rest = t.split(" ")
                    out.append([first[head], *map(after.__getitem__, rest)])
            self._fill()
        except BaseException:
            self.held = {"": _Held(), " ": _Held()}
            raise
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable(s)) for s in self.segments(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def chunks(texts: list[str | None], most: int = CHUNK):
    """(start, end) of runs of texts of about `most` characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>), and with `decoded` the bytes that the ids decode to."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks(texts):
                ids = own.encode(texts[i:j])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                arrays = [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
                if decoded:
                    arrays.append(pa.array(list(map(own.decode, ids)), pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"][: len(arrays)])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(d, run, schema_of("doc_id long, ids array<int>" + ", decoded binary" * decoded))


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids)."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run, schema_of("doc_id long, decoded binary"))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token count and the hashes of the ids and of what they decode to, for each document."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, path, pattern, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) without the ids themselves."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            texts, counts = b.column(1).to_pylist(), []
            for i, j in chunks(texts):
                counts += [sum(map(len, s)) for s in own.segments(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(d, run, schema_of("doc_id long, n_tokens long"))


def query(spark, sf_dir):
    return digests(read(spark, sf_dir, "documents"))
