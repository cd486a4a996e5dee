"""Sub-word tokenizers as plug-ins of Column functions.

A tokenizer is any object that pickles and has `encode(texts) -> lists of ids`, `decode(lists of ids) -> texts` and
`adds_up`: whether the ids of two trimmed texts joined by a space are as many as those of the first and of a space with
the second.  `from_file` makes one of a tokenizer file; its content travels with the function, so executors need no file.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Tokenizer(Protocol):
    adds_up: bool

    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[list[int]]) -> list[str]: ...


@lru_cache(4)
def _loaded(content: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given out the cores
    from tokenizers import Tokenizer as Library

    own = Library.from_str(content)
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    return own


#: A space before what is white space in no library; pieces that a worker holds, and their length at most.
_BEFORE_WORD = re.compile(r"(?= (?:[^\W_]|[!-~]))")
HELD, LONGEST = 100_000, 64
#: Characters of a text from which on the faster library takes less time for it whole than its pieces take to be looked up.
LONG = 2000
#: Characters that libraries of other Unicode versions might tell apart otherwise.
_RARE = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]").search
#: The pattern of byte-level files.
_MATCH = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def _held(content: str) -> dict[str, list[int]]:
    return {}


@lru_cache(4)
def _quick(content: str):
    """A faster library with the same merges, where the file's merges are its ids in order after the single bytes."""
    try:
        import tiktoken
    except ImportError:
        return None
    model = json.loads(content)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocab, merges = model.get("vocab"), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or []]
    if model.get("type") != "BPE" or any(model.get(x) for x in ("ignore_merges", "unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    if {vocab.get(c) for c in byte} != set(range(256)) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("own", pat_str=_MATCH, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _starts(content: str) -> frozenset[int]:
    """Ids that begin with a space before a word, where texts are cut."""
    own = _loaded(content)
    return frozenset(i for i in own.get_vocab(False).values() if _BEFORE_WORD.match(own.decode([i])))


class FileTokenizer:
    """A tokenizer of the `tokenizers` library by the content of its file, without special tokens.

    Where no match crosses a space before a word, texts are cut there and each distinct piece is encoded once; long texts
    of common letters go whole through a faster library where it has the same merges.
    """

    #: What a worker has made of the content; told by the content once for each object, since comparing contents takes long.
    _made: tuple | None = None

    def __init__(self, content: str) -> None:
        self.content = content
        told = json.loads(content)
        cut = told.get("pre_tokenizer") or {}
        # these cut before a space, or drop it, so nothing is merged across one
        self.adds_up = cut.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"))

        self.by_piece = self.adds_up and cut.get("type") == "ByteLevel" and not told.get("normalizer") and all(t.get("special") for t in told.get("added_tokens") or [])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def _own(self) -> tuple:
        """(library, faster one or None, held pieces, ids at which texts are cut)."""
        if self._made is None:
            c = self.content
            self._made = _loaded(c), *((_quick(c), _held(c), _starts(c)) if self.by_piece else (None, {}, frozenset()))
        return self._made

    def _whole(self, texts: list[str]) -> list[list[int]]:
        library, quick, *_ = self._own()
        out: list = [quick.encode_ordinary(t) if quick and not _RARE(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, library.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_piece:
            return self._whole(texts)
        quick = self._own()[1]
        if quick and any(len(t) > LONG for t in texts):
            out: list = [quick.encode_ordinary(t) if len(t) > LONG and not _RARE(t) else None for t in texts]
            rest = [i for i, x in enumerate(out) if x is None]
            for i, ids in zip(rest, self._pieces([texts[i] for i in rest])):
                out[i] = ids
            return out
        return self._pieces(texts)

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        known = self._own()[2]
        if len(known) > HELD:
            known.clear()
        parts = [_BEFORE_WORD.split(t) for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in known]
        known.update(zip(new, self._whole(new)))
        out = [list(chain.from_iterable(map(known.__getitem__, x))) for x in parts]
        for p in new:
            if len(p) > LONGEST:  # such as a text without spaces
                del known[p]
        return out

    def starts(self) -> frozenset[int]:
        """Ids before which texts are cut: ids of `encode` from one such to another are those of their own text; none where texts aren't cut."""
        return self._own()[3]

    def decode(self, ids: list[list[int]]) -> list[str]:
        library, quick, *_ = self._own()
        if quick and max(chain.from_iterable(ids), default=0) < quick.n_vocab:  # no special one
            return [quick.decode_bytes(x).decode("utf-8", "replace") for x in ids]
        return library.decode_batch(ids, skip_special_tokens=True)


def from_file(path: str) -> FileTokenizer:
    with open(path, encoding="utf-8") as lines:
        return FileTokenizer(lines.read())


class WordTokenizer:
    """White-space words as ids of a fixed list; words that aren't in it are the id after the last.  For tests and examples."""

    adds_up = True

    def __init__(self, words: list[str]) -> None:
        self.words = [*words, "?"]
        self.at = {w: i for i, w in enumerate(words)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[self.at.get(w, len(self.words) - 1) for w in t.split()] for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [" ".join(self.words[i] for i in x) for x in ids]


def _mapped(values: pd.Series, whole, missing=None) -> pd.Series:
    """`whole` of all values that aren't null."""
    here = values.notna()
    out = pd.Series([missing] * len(values), dtype=object)
    if here.any():
        out[here.to_numpy()] = pd.Series(whole(values[here].tolist()), dtype=object).to_numpy()
    return out


def token_ids(text: Column | str, tokenizer: Tokenizer) -> Column:
    """array<int>; null of a null text."""

    @F.pandas_udf("array<int>")
    def ids(t: pd.Series) -> pd.Series:
        return _mapped(t, tokenizer.encode)

    return ids(text)


def token_count(text: Column | str, tokenizer: Tokenizer) -> Column:
    """The number of sub-words without special ones; null of a null text."""

    @F.pandas_udf("int")
    def count(t: pd.Series) -> pd.Series:
        return _mapped(t, lambda x: list(map(len, tokenizer.encode(x)))).astype("Int32")

    return count(text)


def decoded(ids: Column | str, tokenizer: Tokenizer) -> Column:
    """The text of ids; null of null ids."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return _mapped(x, lambda v: tokenizer.decode([list(map(int, i)) for i in v]))

    return text(ids)
