"""Class-based bigram language model with classes by exchange clustering.

1. Words of the training texts are counted, all of them, in a table in the shared folder.
2. Seed: the TYPES_OWN most frequent words are types of their own, the others are held together in TYPES_SHARED types by their
   ending.  Pairs of neighbouring types are counted over all training texts: at most types^2 numbers.
   The exchange algorithm moves each type to the class that raises the likelihood of the class bigrams most, until no
   type moves.
3. Every other word of the training texts, however rare, is a type of its own from here on: its neighbours' classes are counted
   over all training texts, and it goes to the class that raises the likelihood most while the class table of the seed is
   held fixed.  The words are shared out to all executors, so that the types grow with the vocabulary.
4. A text's probability is the product over its tokens of P(class | class before) x P(word | class), with
   P(d | c) = (n(c, d) + 1) / (n(c) + CLASSES) and P(w | c) = (n(w) + 1) / (n(c) + v(c) + 1), v(c) the words of class c;
   the one more is for all unknown words of the class.  n(c, d) is counted anew with the classes of all words.  Only words that
   no training text holds, and that have no neighbours to go by, get the class of their ending.

Counts of up to LEXICON most frequent words (a bound; the count to reach is read off a histogram of counts) go to all
executors.  Words outside it are listed by document with their places and joined to the table of words, so every word is
scored by its exact count and its own class.

A text's tokens are its words and one end, which stands before the first word as well.

Edge cases: a null or empty text is its end alone; a null id counts as the empty text for the fold; repeated rows are
counted and scored each; without training texts N = V = 0; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import as_bytes, map_arrow, materialise, read, remainder, schema_of

FOLDS, HELD_OUT = 7, 2
TYPES_OWN, TYPES_SHARED, CLASSES = 640, 384, 64
LEXICON = 1 << 17
FLUSH = 200_000
CELLS, TOKENS = 2_000_000, 1 << 23
CHUNK = 1 << 20
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split() cuts at space and 09 to 0D alone."""
    return text.lower().split()


def shared_type(word: bytes) -> int:
    return TYPES_OWN + zlib.crc32(word[-3:]) % TYPES_SHARED


class Types(dict):
    """Word -> its type."""

    def __missing__(self, word: bytes) -> int:
        return shared_type(word)


class Codes(dict):
    """Word -> its place in the lexicon, or minus its type for words outside."""

    def __missing__(self, word: bytes) -> int:
        return -shared_type(word)


def _chunks(texts: list[bytes]):
    """(start, end, tokens of these texts, tokens in each)."""
    start, words, sizes, held = 0, [], [], 0
    for i, t in enumerate(texts):
        w = tokens(t)
        words += w
        words.append(END)
        sizes.append(len(w) + 1)
        held += len(t)
        if held >= CHUNK:
            yield start, i + 1, words, sizes
            start, words, sizes, held = i + 1, [], [], 0
    if sizes:
        yield start, len(texts), words, sizes


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n long) of (doc_id, text bytes); the end is the empty word."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for _, _, words, _ in _chunks(b.column(1).to_pylist()):
                counts.update(words)
                if len(counts) >= FLUSH:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return map_arrow(docs, run, schema_of("word binary, n long")).groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, most: int = LEXICON) -> tuple[list[bytes], np.ndarray, int]:
    """Words counted `least` times or more, by falling count, with their counts; and `least`, the smallest of the
    powers of 2^(1/4) at which they are `most` or fewer."""
    bins = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("bin")).count().collect()
    left, least_bin = most, max((r.bin for r in bins), default=0) + 1
    for r in sorted(bins, key=lambda r: -r.bin):
        left -= r["count"]
        if left < 0:
            break
        least_bin = r.bin
    table = counts.where(F.floor(F.log2("n") * 4) >= least_bin).toArrow()
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order] if len(order) else np.empty(0, np.int64), least_bin


def count_pairs(docs: DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """How often each type stands before each, over all of (doc_id, text bytes)."""
    size = TYPES_OWN + TYPES_SHARED

    def run(batches):
        types, cells = Types(own), np.zeros(size * size, np.int64)
        for b in batches:
            for _, _, words, _ in _chunks(b.column(1).to_pylist()):
                seq = np.fromiter(map(types.__getitem__, words), np.int64, len(words))
                cells += np.bincount(np.concatenate((seq[-1:], seq[:-1])) * size + seq, minlength=size * size)
        at = np.nonzero(cells)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], names=["pair", "n"])

    table = map_arrow(docs, run, schema_of("pair int, n long")).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each type: from round robin by frequency, each type in turn goes where the likelihood is highest."""
    total = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-total, kind="stable")
    own = np.empty(len(pairs), np.int64)
    own[order] = np.arange(len(pairs)) % classes
    member = np.zeros((len(pairs), classes), np.float64)
    member[np.arange(len(pairs)), own] = 1
    right, left = pairs @ member, pairs.T @ member  # counts of a type with the classes after and before it
    table = member.T @ right
    n_out, n_in = table.sum(1), table.sum(0)
    moved = 1
    while moved:  # each move raises the likelihood, so this ends
        moved = 0
        for t in order.tolist():
            if not total[t]:
                continue
            a, r, f, same = own[t], right[t].copy(), left[t].copy(), float(pairs[t, t])
            r[a] -= same
            f[a] -= same
            table[a] -= r
            table[:, a] -= f
            table[a, a] -= same
            n_out[a] -= r.sum() + same
            n_in[a] -= f.sum() + same
            gain = (_xlogx(table + r) - _xlogx(table)).sum(1) + (_xlogx(table + f[:, None]) - _xlogx(table)).sum(0)
            d = np.diag(table)
            gain += _xlogx(d + r + f + same) - _xlogx(d + r) - _xlogx(d + f) + _xlogx(d)
            gain -= _xlogx(n_out + r.sum() + same) - _xlogx(n_out) + _xlogx(n_in + f.sum() + same) - _xlogx(n_in)
            to = int(np.argmax(gain))
            if gain[to] <= gain[a] + 1e-9:
                to = a
            table[to] += r
            table[:, to] += f
            table[to, to] += same
            n_out[to] += r.sum() + same
            n_in[to] += f.sum() + same
            if to != a:
                moved += 1
                own[t] = to
                for side, counts in ((right, pairs[:, t]), (left, pairs[t])):
                    side[:, a] -= counts
                    side[:, to] += counts
    return own


class Places(dict):
    """Word -> its place; new words are put at the end, with the class of their ending."""

    def __init__(self, words: list[bytes], word_class: np.ndarray, classes: np.ndarray) -> None:
        super().__init__(zip(words, range(len(words))))
        self.words, self.classes, self.ending = words, word_class.tolist(), classes.tolist()
        self.first = len(words)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        self.classes.append(self.ending[shared_type(word)])
        return at

    def forget(self) -> None:
        for word in self.words[self.first :]:
            del self[word]
        del self.words[self.first :], self.classes[self.first :]


def _contexts(docs: DataFrame, sent) -> DataFrame:
    """(word, cells): how often the classes stand after and before a word, each cell as count << 8 | side and class."""
    width = 2 * CLASSES

    def run(batches):
        words, word_class, classes = sent.value
        places = Places(words.to_pylist(), word_class, classes)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = tokens = 0

        def rows():
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)
            own = keys // width
            first = np.nonzero(np.diff(own, prepend=-1))[0]
            cells = (n << 8 | keys % width).astype("<u8")
            ends = np.append(first, len(keys)).astype(np.int32) * 8
            packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(cells)])
            return pa.RecordBatch.from_arrays([pa.array([places.words[i] for i in own[first].tolist()], pa.binary()), packed], names=["word", "cells"])

        for b in batches:
            for _, _, toks, _ in _chunks(b.column(1).to_pylist()):
                seq = np.fromiter(map(places.__getitem__, toks), np.int64, len(toks))
                c = np.array(places.classes)[seq]
                held.append(np.unique(np.concatenate((seq * width + np.roll(c, -1), seq * width + CLASSES + np.roll(c, 1))), return_counts=True))
                size += len(held[-1][0])
                tokens += len(seq)
                if size >= CELLS or tokens >= TOKENS or len(places.words) - places.first >= FLUSH:
                    yield rows()
                    held, size, tokens = [], 0, 0
                    places.forget()
        if held:
            yield rows()

    return map_arrow(docs, run, schema_of("word binary, cells binary"))


def word_classes(docs: DataFrame, words: list[bytes], own: dict[bytes, int], classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, n, c) of all words of (doc_id, text bytes): seeds keep their class, each other word gets the best against `table`."""
    types = Types(own)
    word_class = classes[np.fromiter(map(types.__getitem__, words), np.int64, len(words))]
    sent = docs.sparkSession.sparkContext.broadcast((pa.array(words, pa.binary()), word_class, classes))
    # what one more pair adds to the likelihood, with the other counts as they are
    follow = np.log(table + 1) - np.log(table.sum(1) + CLASSES)[:, None]
    lead = np.log(table + 1) - np.log(table.sum(0) + CLASSES)[None, :]
    gain = np.zeros((2 * CLASSES, CLASSES))
    gain[: len(table), : len(table)], gain[CLASSES : CLASSES + len(table), : len(table)] = follow.T, lead
    gain[:, len(table) :] = -np.inf
    dealt = _contexts(docs, sent).repartition("word").sortWithinPartitions("word")

    def rows(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        best = np.argmax(counts @ gain, 1)
        for i, w in enumerate(words):
            if w in own:
                best[i] = classes[own[w]]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts[:, :CLASSES].sum(1).astype(np.int64)), pa.array(best.astype(np.int16))], names=["word", "n", "c"])

    def run(batches):
        last, held = None, np.zeros(2 * CLASSES)  # the open word: more of its rows may come
        for b in batches:
            if not b.num_rows:
                continue
            names, cells = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = np.repeat(np.cumsum([x != y for x, y in zip(names, [names[0], *names])]), [len(x) // 8 for x in cells])
            flat = np.frombuffer(b"".join(cells), "<u8").astype(np.int64)
            found = list(dict.fromkeys(names))
            counts = np.bincount(at * 2 * CLASSES + (flat & 255), flat >> 8, len(found) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            if last == found[0]:
                counts[0] += held
            elif last is not None:
                yield rows([last], held[None, :])
            last, held = found[-1], counts[-1]
            yield rows(found[:-1], counts[:-1])
        if last is not None:
            yield rows([last], held[None, :])

    return map_arrow(dealt, run, schema_of("word binary, n long, c short"))


def _coded(raw: DataFrame, words: list[bytes], n: np.ndarray, word_class: np.ndarray, classes: np.ndarray, base_under: float) -> DataFrame:
    """Documents with the class of each token, a byte each; `tail` has the tokens outside the lexicon with their places."""
    sent = raw.sparkSession.sparkContext.broadcast((pa.array(words, pa.binary()), np.log10(n + 1.0), word_class, classes))

    def run(batches):
        words, log_n, word_class, classes = sent.value
        codes = Codes(zip(words.to_pylist(), range(len(words))))
        for b in batches:
            for i, j, toks, sizes in _chunks(b.column(1).to_pylist()):
                code = np.fromiter(map(codes.__getitem__, toks), np.int64, len(toks))
                known = code >= 0
                at = np.where(known, code, 0)
                cls = np.where(known, word_class[at], classes[np.where(known, 0, -code)]) if len(word_class) else classes[-code]
                num = np.where(known, log_n[at], 0.0) if len(log_n) else np.zeros(len(code))
                sizes = np.array(sizes)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                starts = ends[:-1]
                rare = np.nonzero(~known)[0]
                doc = np.searchsorted(starts, rare, "right") - 1
                tail = pa.StructArray.from_arrays([pa.array((rare - starts[doc]).astype(np.int32)), pa.array([toks[k] for k in rare.tolist()], pa.binary())], names=["at", "word"])
                tails = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=j - i)))).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cls.astype(np.uint8))])
                num = np.add.reduceat(num, starts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(num), pa.array(num - sizes * base_under), packed, pa.ListArray.from_arrays(pa.array(tails), tail)],
                    names=["doc_id", "held_out", "n_tokens", "n_lexicon", "num", "base", "classes", "tail"],
                )

    return map_arrow(raw, run, schema_of("doc_id long, held_out boolean, n_tokens long, n_lexicon long, num double, base double, classes binary, tail array<struct<at: int, word: binary>>"))


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row starts."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows[:-1])])


def _filled(coded: DataFrame, rare: DataFrame) -> DataFrame:
    """`coded` with the counts and the classes of the words outside the lexicon that training texts hold."""
    tail = coded.select("row", F.explode("tail").alias("t")).select("row", "t.at", "t.word")
    more = tail.join(rare, "word").groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.collect_list(F.struct("at", "c")).alias("fill"))
    num = F.coalesce("more", F.lit(0.0))
    both = coded.drop("tail").join(more, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_lexicon") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), (F.col("num") + num).alias("num"), (F.col("base") + num).alias("base"), "classes", F.col("fill.at").alias("at"), F.col("fill.c").alias("c"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, starts = _sequences(b.column(6))
            data = data.copy()
            sizes = np.array([len(x) if x else 0 for x in b.column(7).to_pylist()])
            at, c = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (7, 8))
            data[np.repeat(starts, sizes) + at.astype(np.int64)] = c
            ends = np.append(starts, len(data)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), packed], names=["doc_id", "held_out", "n_tokens", "n_known", "num", "base", "classes"])

    return map_arrow(both, run, schema_of("doc_id long, held_out boolean, n_tokens long, n_known long, num double, base double, classes binary"))


def _class_pairs(filled: DataFrame, k: int) -> np.ndarray:
    """How often each class stands before each in the training texts."""

    def run(batches):
        cells = np.zeros(k * k, np.int64)
        for b in batches:
            if b.num_rows:
                c = _sequences(b.column(0))[0].astype(np.int64)
                cells += np.bincount(np.roll(c, 1) * k + c, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(cells)], names=["pair", "n"])

    out = np.zeros(k * k, np.int64)
    for r in map_arrow(filled.where(~F.col("held_out")).select("classes"), run, schema_of("pair int, n long")).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(k, k)


def score(docs: DataFrame) -> DataFrame:
    """A row for each document: the unigram base score, the model's score and its perplexity."""
    raw = as_bytes(docs, (remainder(FOLDS) == HELD_OUT).alias("held_out"))
    train = raw.where(~F.col("held_out")).select("doc_id", "text")
    counts = materialise(count_words(train), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words, n, least_bin = lexicon(counts)
    own = {END: 0} | {w: i for i, w in enumerate((w for w in words[:TYPES_OWN] if w != END), 1) if i < TYPES_OWN}
    pairs = count_pairs(train, own)
    classes = exchange(pairs)
    k = int(classes.max()) + 1
    member = np.zeros((len(pairs), k))
    member[np.arange(len(pairs)), classes] = 1

    table = materialise(word_classes(train, words, own, classes, member.T @ pairs @ member), "words")
    frequent = F.floor(F.log2("n") * 4) >= least_bin
    found = table.where(frequent).select("word", "c").toArrow()
    class_of = dict(zip(found.column("word").to_pylist(), found.column("c").to_pylist()))
    word_class = np.array([class_of[w] for w in words], np.int64)
    class_n, class_v = np.zeros(k), np.zeros(k)
    for r in table.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r.c], class_v[r.c] = r.n, r.v

    coded = materialise(_coded(raw, words, n, word_class, classes, math.log10(total.n + total.v + 1)).withColumn("row", F.monotonically_increasing_id()), "coded")
    filled = materialise(_filled(coded, table.where(~frequent)), "filled")
    pairs = _class_pairs(filled, k)
    step = np.log10((pairs + 1) / (pairs.sum(1, keepdims=True) + k)) - np.log10(class_n + class_v + 1)[None, :]
    end = int(classes[0])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c, starts = _sequences(b.column(6))
            before = np.concatenate(([end], c[:-1]))
            model = np.add.reduceat(step[before, c], starts) + b.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 3, 5)), pa.array(model)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = map_arrow(filled, run, schema_of("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total.n)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def query(spark, sf_dir):
    return score(read(spark, sf_dir, "documents"))
