"""Batched scoring of query-document pairs with a trace of its speed.

A pair is a prompt of sub-words: fixed ids, the body cut to what is left of the limit, fixed ids.  Within a task pairs are
taken WINDOW at a time and sorted by length before they are cut into batches, so that a batch is padded to little more
than its own pairs; scores go back to the rows they belong to, in any order.  Each row tells the seconds of its batch once
and whether the batch was its task's first one (which pays for the warm-up), so that one observation of the rows has the
whole trace without a second job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gristmill import importable
from gristmill.functions.answers import PAIR, PAIR_AFTER, PAIR_BEFORE, fill
from gristmill.functions.tokens import Tokenizer
from gristmill.operators.scoring import final_margin, probability

LIMIT, BATCH, WINDOW = 512, 32, 4096
#: (ids, mask) of a batch, padded on the left, to the logits (pairs, ids, vocabulary).
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def encoded_bodies(tokenizer: Tokenizer, bodies: list[str], limit: int = LIMIT) -> list[list[int]]:
    """The ids of each pair's prompt, at most `limit` of them; a limit that the fixed parts fill is refused."""
    before, after = tokenizer.encode([PAIR_BEFORE, PAIR_AFTER])
    room = limit - len(before) - len(after)
    if room <= 0:
        raise ValueError("the limit leaves no room for a pair")
    return [[*before, *ids[:room], *after] for ids in tokenizer.encode(bodies)]


def padded(prompts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask), padded on the left to the longest prompt."""
    width = max(map(len, prompts))
    ids, mask = np.zeros((len(prompts), width), np.int64), np.zeros((len(prompts), width), np.int8)
    for row, p in enumerate(prompts):
        ids[row, width - len(p) :] = p
        mask[row, width - len(p) :] = 1
    return ids, mask


def batches_by_length(prompts: list[list[int]], size: int) -> list[np.ndarray]:
    """Places of prompts in batches, the longest first, so that memory is tried at once; ties keep their order."""
    order = np.argsort([-len(p) for p in prompts], kind="stable")
    return [order[i : i + size] for i in range(0, len(order), size)]


def _windows(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        while n >= size:
            whole = pd.concat(held, ignore_index=True)
            yield whole.iloc[:size]
            held, n = [whole.iloc[size:]], n - size
    if n:
        yield pd.concat(held, ignore_index=True)


def score_pairs(
    rows: DataFrame, keys: list[str], query: Column, document: Column, instruction: Column, tokenizer: Tokenizer, make: Callable[[], Model], yes: int, no: int, *, limit: int = LIMIT, batch: int = BATCH, window: int = WINDOW
) -> tuple[DataFrame, Observation]:
    """(keys, score_margin, score_probability, n_tokens) of every row, and the observation for `trace`.

    `make` loads the model in a worker, once for each task.  Only the keys and the rendered body travel.  A null query or
    document counts as empty.
    """
    importable(rows.sparkSession)
    text = lambda c: F.coalesce(c, F.lit(""))
    own = rows.select(*keys, fill(PAIR, i=text(instruction), q=text(query), d=text(document)).alias("_body"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.select(*keys).schema)

    def run(frames):
        model, first = make(), True
        for w in _windows(frames, window):
            prompts = encoded_bodies(tokenizer, w["_body"].tolist(), limit)
            margins, seconds, warming = np.empty(len(w)), np.zeros(len(w)), np.zeros(len(w), bool)
            for places in batches_by_length(prompts, batch):
                ids, mask = padded([prompts[i] for i in places])
                began = time.perf_counter()
                margins[places] = final_margin(model(ids, mask), mask, yes, no)
                seconds[places[0]] = time.perf_counter() - began
                warming[places], first = first, False
            yield w[keys].assign(score_margin=margins, n_tokens=[len(p) for p in prompts], _seconds=seconds, _warming=warming)

    scored = own.mapInPandas(run, f"{kinds}score_margin double, n_tokens int, _seconds double, _warming boolean")
    seen = Observation()
    steady = lambda c: F.sum(F.when(~F.col("_warming"), c).otherwise(0))
    scored = scored.observe(
        seen, F.count(F.lit(1)).alias("pairs"), F.sum("_seconds").alias("seconds"), steady(F.lit(1)).alias("steady_pairs"), steady(F.col("_seconds")).alias("steady_seconds"), F.max(F.when(F.col("_warming"), F.col("_seconds"))).alias("first_batch_seconds"), F.count_if(F.col("_seconds") > 0).alias("batches")
    )
    return scored.select(*keys, "score_margin", probability(F.col("score_margin")).alias("score_probability"), "n_tokens"), seen


def trace(seen: Observation) -> dict:
    """What an observation tells once its rows were used: rates over all batches and without each task's first one.

    Where there are no others, the steady rate is that of all batches.
    """
    s = {k: v or 0 for k, v in seen.get.items()}
    rate = lambda pairs, seconds: pairs / seconds if seconds else None
    if not s["steady_pairs"]:
        s["steady_pairs"], s["steady_seconds"] = s["pairs"], s["seconds"]
    return s | {"pairs_per_second": rate(s["pairs"], s["seconds"]), "steady_pairs_per_second": rate(s["steady_pairs"], s["steady_seconds"])}
