"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text.  A text is cut into blocks of BLOCK bytes, all
of it, and each block is compressed with either; the difference of the summed sizes over their sum is the normalised
difference.  A logistic calibration, fitted on labelled texts that the dictionaries haven't seen, turns it, with the
ratio to the raw size and the length, into the chance of label 1.

The fit takes SAMPLE labelled ids of each label, the first by the crc32 of the id, whatever the length of their texts.
Three in five are for the dictionaries, which get at most SAMPLE_BLOCKS blocks of each text, evenly spread over it: a bound
of 1.2 x SAMPLE x SAMPLE_BLOCKS x BLOCK bytes on the driver. The others are for the calibration: executors measure their
whole texts and send the features alone. As labels may be sampled at different rates, a row of the calibration weighs as many
labels as it stands for, so that the chance is that of the labels themselves at every size. The fit is a penalised one, whose
optimum is finite where the labels can be told apart without fault, and is reached by steps that are halved until they help.

Edge cases: an empty or null text scores as its features (0, 0, 0) calibrate; where either label has fewer than two sampled
texts nothing can be fitted, and every text scores the share of label 1 (0.5 without any labels); null labels and labels
other than 0 and 1 are left out; a label given twice counts once, an id with both labels for both; of sampled rows with equal
ids the smallest text counts; ids that tie in the crc32 are taken in their own order; repeated rows get a row each; empty
tables give an empty result; further columns are left out.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import as_bytes, map_arrow, read, remainder, schema_of

BLOCK, LEVEL, DICTIONARY = 512, 3, 65_536
SAMPLE, SAMPLE_BLOCKS = 4_000, 12
FOLDS, THRESHOLD = 5, 0.3
RIDGE = 0.01


class Model(NamedTuple):
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


class Sizer:
    """Compressed sizes of a text with either dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = []
        for raw in (good, bad):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def features(self, text: bytes) -> tuple[float, ...]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        good, bad = (sum(map(len, map(compress, blocks))) for compress in self.by)
        d = (bad - good) / max(1, good + bad)
        r = math.log((good + bad + 16) / (2 * len(text) + 16))
        n = math.log1p(len(text))
        return d, r, n, d * d, r * r, d * r, d * n, r * n, n * n


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> float:
    z = x @ w
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * (w[1:] ** 2).sum())


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights, the first for the constant, of the penalised logistic fit: Newton's steps, halved until the loss falls."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[0] = 1e-9
    loss = _loss(x, y, weight, w)
    for _ in range(rounds):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (weight * (y - p)) - penalty * w)
        for _ in range(40):
            new = _loss(x, y, weight, w + step)
            if new <= loss:
                break
            step /= 2
        else:
            break
        w, fell, loss = w + step, loss - new, new
        if fell < 1e-9 * (1 + loss):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    counts, chosen = sample(labels)
    parts = {(part, label): [i for i, q, p in chosen if (p, q) == (part, label)] for part in (0, 1) for label in (0, 1)}
    texts, x, y = [[], []], np.empty((0, 9)), np.empty(0)
    if all(parts.values()):
        ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int, part int")
        for r in sorted(_spread(docs, ids.where("part = 0")).collect(), key=lambda r: (zlib.crc32(b"fit%d" % r.doc_id), r.doc_id)):
            texts[r.quality].append([bytes(block) for block in r.blocks])
    if all(texts):
        dictionaries = [_dictionary([block for text in texts[label] for block in text]) for label in (1, 0)]
        rows = sorted((r.doc_id, r.quality, tuple(r.x)) for r in _measured(docs, ids.where("part = 1"), *dictionaries).collect())
        x, y = np.array([r[2] for r in rows]).reshape(-1, 9), np.array([float(r[1]) for r in rows])
    if len(set(y.tolist())) < 2:
        share = counts[1] / sum(counts) if any(counts) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", (0.0,) * 9, (1.0,) * 9, (math.log(share / (1 - share)), *(0.0,) * 9))
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(*dictionaries, tuple(mean), tuple(scale), tuple(_newton(np.c_[np.ones(len(x)), (x - mean) / scale], y, weight * len(y) / weight.sum())))


def _dictionary(blocks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is the dictionary itself
        return b"".join(blocks)[-DICTIONARY:] or b" "


def scorer(model: Model):
    """A function from a list of texts to their scores."""
    sizer = Sizer(model.good, model.bad) if model.good and model.bad else None
    mean, scale, weights = (np.array(v) for v in (model.mean, model.scale, model.weights))

    def score(texts: list[bytes]) -> np.ndarray:
        x = np.array([sizer.features(t) if sizer else (0.0,) * 9 for t in texts]).reshape(-1, 9)
        return _logistic(np.c_[np.ones(len(x)), (x - mean) / scale] @ weights)

    return score


def sample(labels: DataFrame) -> tuple[tuple[int, int], list[tuple[int, int, int]]]:
    """How many labels 0 and 1 the learning folds have, the ids whose crc32 isn't divisible by FOLDS; and SAMPLE of each
    label at most as (doc_id, label, part): part 0 for the dictionaries, 1 for the calibration."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(remainder(FOLDS) != 0).distinct()
    n = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    by = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary"))
    firsts = [[r.doc_id for r in marks.where(F.col("quality") == label).orderBy(by, "doc_id").limit(SAMPLE).collect()] for label in (0, 1)]
    return (n.get(0, 0), n.get(1, 0)), [(i, label, int(place % 5 in (1, 3))) for label, ids in enumerate(firsts) for place, i in enumerate(ids)]


def _spread(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, quality, blocks) of sampled documents: at most SAMPLE_BLOCKS blocks, evenly spread over the text."""

    def run(batches):
        for b in batches:
            taken = []
            for text in b.column(1).to_pylist():
                places = range(-(-len(text) // BLOCK))
                if len(places) > SAMPLE_BLOCKS:
                    places = [i * (len(places) - 1) // (SAMPLE_BLOCKS - 1) for i in range(SAMPLE_BLOCKS)]
                taken.append([text[i * BLOCK : (i + 1) * BLOCK] for i in places])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(taken, pa.list_(pa.binary()))], names=["doc_id", "quality", "blocks"])

    return _once(map_arrow(as_bytes(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality"), run, schema_of("doc_id long, quality int, blocks array<binary>")), "blocks")


def _measured(docs: DataFrame, ids: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """(doc_id, quality, x) of sampled documents: the features of the whole text."""

    def run(batches):
        sizer = Sizer(good, bad)
        for b in batches:
            x = [sizer.features(text) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    return _once(map_arrow(as_bytes(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality"), run, schema_of("doc_id long, quality int, x array<double>")), "x")


def _once(rows: DataFrame, value: str) -> DataFrame:
    """One row for each id and label: rows that come again, be they a third of the table, don't go to the driver."""
    return rows.groupBy("doc_id", "quality").agg(F.min(value).alias(value))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    model = fit(docs, labels)

    def run(batches):
        score = scorer(model)
        for b in batches:
            s = score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(as_bytes(docs, (remainder(FOLDS) == 0).alias("held_out")), run, schema_of("doc_id long, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that aren't rejected."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        score = scorer(model)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(score(texts) >= threshold))

    return map_arrow(docs, run, docs.schema)


def query(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
