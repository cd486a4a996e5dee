"""Clustered statistics and selections.

Randomness comes from the md5 of (seed, unit), mixed with the number of the draw in 32-bit arithmetic, so that any
partitioning, and SQL, makes the same draws.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill import importable


#: The multipliers of a public 32-bit finaliser, and the step between draws.
MIX_1, MIX_2, STEP, WORD = 2246822507, 3266489909, 2654435769, 1 << 32


def keys(seed: int, unit: Column) -> tuple[Column, Column]:
    """Two 32-bit numbers from the md5 of (seed, unit)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), unit.cast("string")))
    return tuple(F.conv(F.substring(h, at, 8), 16, 10).cast("long") for at in (1, 9))


def mixed(k1: Column, k2: Column, draw: Column) -> Column:
    """A 32-bit number of (unit, draw), as `mixed_array` has it."""

    def times(x: Column, by: int) -> Column:  # in halves, so that a long holds the products
        high = (F.shiftright(x, 16) * F.lit(by)).bitwiseAND(F.lit(0xFFFF))
        return (F.shiftleft(high, 16) + x.bitwiseAND(F.lit(0xFFFF)) * F.lit(by)).bitwiseAND(F.lit(WORD - 1))

    def mix(x: Column) -> Column:
        x = times(x.bitwiseXOR(F.shiftright(x, 16)), MIX_1)
        x = times(x.bitwiseXOR(F.shiftright(x, 13)), MIX_2)
        return x.bitwiseXOR(F.shiftright(x, 16))

    return mix(mix((k1 + draw * F.lit(STEP)).bitwiseAND(F.lit(WORD - 1))).bitwiseXOR(k2))


def mixed_array(k1: np.ndarray, k2: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """uint32 of every unit (rows) and draw (columns)."""
    return mixed_block(k1.astype(np.uint32)[:, None], k2.astype(np.uint32)[:, None], draws.astype(np.uint32)[None, :] * np.uint32(STEP))


def mixed_block(k1: np.ndarray, k2: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """`mixed_array` of columns of keys and a row of draws times STEP, all uint32."""
    x = k1 + steps
    held = np.empty_like(x)

    def shifted(by: int) -> None:
        np.right_shift(x, np.uint32(by), out=held)
        np.bitwise_xor(x, held, out=x)

    shifted(16)
    for again in (True, False):
        x *= np.uint32(MIX_1)
        shifted(13)
        x *= np.uint32(MIX_2)
        if again:  # the shifts by 16 on both sides of the second key leave it with its own
            x ^= k2 ^ k2 >> np.uint32(16)
        else:
            shifted(16)
    return x


def families(rows: DataFrame, value: str, family: str, domain: str | None = None) -> DataFrame:
    """(domain, family, s, n): sums by family, all that the resampling needs."""
    by = [family] if domain is None else [domain, family]
    return rows.groupBy(*by).agg(F.sum(value).alias("s"), F.count("*").alias("n"))


#: Units and draws of a block of random numbers.
UNITS, DRAWS = 512, 2048
#: Of the bootstrap: numbers of a block, families of a row that goes to the tasks and of a task at once, and tasks a core.
BLOCK, CHUNK, HELD, WAVES = 1 << 16, 8192, 1 << 23, 2


def _summed(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(draw, columns): arrays of blocks of draws, added up over the tasks."""
    long = parts.select("first", F.posexplode(F.arrays_zip(*columns)).alias("at", "x"))
    return long.groupBy((F.col("first") + F.col("at")).alias("draw")).agg(*[F.sum(f"x.{c}").alias(c) for c in columns])


def sign_flips(f: DataFrame, family: str, draws: int, seed: int) -> DataFrame:
    """(draw, t): the sum of all families' sums under a random sign each; a number has the signs of 32 draws in its bits.

    Every task multiplies its families' sums with blocks of the sign matrix, and sends one number for each draw.
    """
    importable(f.sparkSession)
    k1, k2 = keys(seed, F.col(family))
    own = f.select(k1.alias("k1"), k2.alias("k2"), F.col("s").cast("double").alias("s")).repartition(f.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        total = np.zeros(-(-draws // DRAWS) * DRAWS)
        for b in batches:
            s = b["s"].fillna(0.0).to_numpy()
            for u in range(0, len(b), UNITS):
                part = s[u : u + UNITS]
                for d in range(0, draws, DRAWS):
                    words = mixed_array(b["k1"].to_numpy()[u : u + UNITS], b["k2"].to_numpy()[u : u + UNITS], np.arange(d // 32, (d + DRAWS) // 32))
                    bits = np.unpackbits(words.astype("<u4").view(np.uint8), axis=1, bitorder="little")
                    total[d : d + DRAWS] += part.sum() - 2 * (part @ bits.astype(np.float64))
        if total.any():
            yield pd.DataFrame([(d, total[d : min(d + DRAWS, draws)]) for d in range(0, draws, DRAWS)], columns=["first", "t"])

    return _summed(own.mapInPandas(run, "first long, t array<double>"), ["t"])


def sign_flip_p(rows: DataFrame, value: str, family: str, draws: int, seed: int) -> DataFrame:
    """Whole families change sign; p = (1 + draws as extreme as observed) / (draws + 1)."""
    f = families(rows, value, family)
    total = f.agg(F.sum("s").alias("total"), F.sum("n").alias("docs"))
    null = rows.sparkSession.range(draws).select(F.col("id").alias("draw")).join(sign_flips(f, family, draws, seed), "draw", "left")
    extreme = F.abs(F.round(F.coalesce("t", F.lit(0.0)), 9)) >= F.abs(F.round("total", 9))
    return null.crossJoin(F.broadcast(total)).agg(F.max(F.col("total") / F.col("docs")).alias("observed"), F.count("*").alias("draws"), ((F.sum(extreme.cast("long")) + 1) / (F.count("*") + 1)).alias("p"))


def numbered(f: DataFrame, family: str, domain: str) -> DataFrame:
    """(domain, i, s, n, size, start, total): families of a domain numbered by the md5 of their name, null last.

    They are numbered within a bucket, the first digits of the md5, and moved by the families in the buckets before it,
    so that no task holds a whole domain. `start` is the number of families of the domains before it, `total` that of all.
    """
    h = F.md5(F.col(family).cast("string"))
    b = f.select(F.col(domain).alias("domain"), F.col(family).alias("family"), F.unhex(h).alias("h"), F.coalesce(F.substring(h, 1, 3), F.lit("null")).alias("bucket"), "s", "n")
    # no use of the sums leaves a column out, so that both read one shuffle
    counts = b.groupBy("domain", "bucket").agg(F.count("*").alias("own"), F.count("s").alias("valued"), F.sum("n").alias("docs")).where("valued >= 0 and docs > 0")
    line, own = W.partitionBy(F.lit(1)), W.partitionBy("domain")  # a row for each bucket
    counts = counts.withColumns({"ahead": F.coalesce(F.sum("own").over(line.orderBy("domain", "bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("own").over(line)})
    counts = counts.select("domain", "bucket", "ahead", "total", F.min("ahead").over(own).alias("start"), F.sum("own").over(own).alias("size"))
    place = F.row_number().over(W.partitionBy("domain", "bucket").orderBy("h", "family")) - 1
    return b.withColumn("place", place).join(counts, ["domain", "bucket"]).select("domain", (F.col("ahead") - F.col("start") + F.col("place")).cast("long").alias("i"), "s", "n", "size", "start", "total")


def bootstrap(rows: DataFrame, value: str, family: str, domain: str, draws: int, seed: int) -> DataFrame:
    """(draw, mean): families are drawn with replacement within their domain; the mean is over the documents drawn.

    Slot i of a domain draws family number `mixed` modulo the domain's families. The draws of all domains, each as long as
    the domain has families, stand in one line that is cut into equal parts, one for each task. A task gets the sums of the
    domains that its part touches, HELD families at once, and sends two sums and a count for each draw.
    """
    spark = rows.sparkSession
    importable(spark)
    tasks = WAVES * spark.sparkContext.defaultParallelism
    f = numbered(families(rows, value, family, domain).where(F.col(domain).isNotNull()), family, domain)
    chunks = f.groupBy("domain", "start", "size", "total", F.floor(F.col("i") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("i", "s", "n"))).alias("x"))
    part = lambda draw: F.call_function("div", (F.col("start") * draws + F.col("size") * draw) * tasks, F.col("total") * draws).cast("int")
    numbers = [F.transform(f"x.{c}", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias(c) for c in ("s", "n")]
    valued = F.transform("x.s", lambda v: v.isNotNull()).alias("valued")
    sent = chunks.select(F.col("domain").cast("string").alias("domain"), "start", "size", "total", "chunk", *numbers, valued, F.explode(F.sequence(part(0), part(draws - 1))).alias("part"))
    sent = sent.repartitionById(tasks, F.col("part")).sortWithinPartitions("start", "chunk")
    chunk, held, block = CHUNK, max(1, HELD // CHUNK), BLOCK

    def run(batches):
        sums = np.zeros((3, draws))
        unit, work = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                start, size, total, at = int(r.start), int(r.size), int(r.total), int(r.chunk) // held * held * chunk
                if unit != (start, at):
                    if unit:
                        drawn(sums, *work, seed, held * chunk, block)
                    unit = start, at
                    own = np.zeros((3, min(held * chunk, size - at)))
                    reach = (-(-(-(-p * total * draws // tasks) - start * draws) // size) for p in (int(r.part), int(r.part) + 1))  # as `part` has it
                    work = r.domain, size, at, own, range(*(min(max(x, 0), draws) for x in reach))
                place = int(r.chunk) * chunk - at
                own[:, place : place + len(r.s)] = r.s, r.n, r.valued
        if unit:
            drawn(sums, *work, seed, held * chunk, block)
            yield pd.DataFrame([(d, *sums[:, d : d + DRAWS]) for d in range(0, draws, DRAWS)], columns=["first", "s", "n", "valued"])

    sums = sent.mapInPandas(run, "first long, s array<double>, n array<double>, valued array<double>")
    return _summed(sums, ["s", "n", "valued"]).select("draw", F.when(F.col("valued") > 0, F.col("s") / F.col("n")).alias("mean"))


def drawn(sums: np.ndarray, domain: str, size: int, at: int, own: np.ndarray, reach: range, seed: int, held: int, block: int) -> None:
    """Add to `sums`, a row for each row of `own`, what the draws of `reach` find: `own` are the families from number `at` on.

    How often a draw has a family is counted in a table of bytes, small enough for the caches; a draw that has one more
    often than a byte holds is counted anew.
    """
    width = own.shape[1]
    odd = np.flatnonzero(~np.isfinite(own).all(0))  # these only count where they are drawn
    strange = own[:, odd]
    own[:, odd] = 0
    for first in range(0, size, held):
        slots = range(first, min(first + held, size))
        k = np.frombuffer(b"".join(hashlib.md5(f"{seed}|{domain}:{i}".encode()).digest()[:8] for i in slots), ">u4").astype(np.uint32).reshape(-1, 2)
        k1, k2 = k.T.copy()[:, None]
        step = max(1, block // max(len(slots), width))
        for d in range(reach.start, reach.stop, step):
            steps = (np.arange(d, min(d + step, reach.stop)).astype(np.uint32) * np.uint32(STEP))[:, None]
            for kind in (np.uint8, np.uint32):
                counts = np.zeros((len(steps), width), kind)
                n = 0
                for u in range(0, len(slots), block):
                    x = mixed_block(k1[:, u : u + block], k2[:, u : u + block], steps)
                    x -= x // np.uint32(size) * np.uint32(size)  # faster than %
                    x -= np.uint32(at)
                    place = x + np.arange(len(steps))[:, None] * width
                    if width < size:
                        place = place[x < width]
                    np.add.at(counts.reshape(-1), place.reshape(-1), kind(1))
                    n += place.size
                if counts.sum(dtype=np.int64) == n:
                    break
            for u in range(0, width, block):
                sums[:, d : d + len(steps)] += own[:, u : u + block] @ counts[:, u : u + block].T.astype(np.float64)
            if len(odd):
                c = counts[:, odd].T
                with np.errstate(invalid="ignore"):
                    sums[:, d : d + len(steps)] += np.where(c > 0, strange[:, :, None] * c, 0).sum(1)


#: Ranges that a group's values are dealt to; a task holds the distinct values of one.
RANGES = 64


def _same(a: str, b: str, by: list[str]) -> Column:
    """Equal keys, nulls too."""
    return reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), by, F.lit(True))


def _beside(rows: DataFrame, groups: DataFrame, by: list[str], more: list[str], columns: list[str]) -> DataFrame:
    """`rows` with columns of `groups`, a table with a row for each (by, more)."""
    if not by and not more:
        return rows.crossJoin(F.broadcast(groups))
    return rows.alias("r").join(groups.alias("g"), _same("r", "g", [*by, *more])).select("r.*", *[f"g.{c}" for c in columns])


def ordered(rows: DataFrame, column: Column, by: list[str]) -> DataFrame:
    """(by, value, own, before, n): each distinct value of a group with its rows, the rows of smaller values, and all rows.

    Values are counted, then dealt to ranges by approximate cut points; they are summed up inside a range and moved by the
    ranges before it. The result is exact whatever the cuts, and no task has a whole group. Nulls are left out.
    """
    counts = rows.select(*by, column.alias("value")).where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("own"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    value = F.col("value")
    placed = _beside(counts, cuts, by, [], ["cuts"]).withColumn("range", F.size(F.filter("cuts", lambda c: c <= value))).drop("cuts")
    ranges = placed.groupBy(*by, "range").agg(F.sum("own").alias("own"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))  # at most RANGES rows of each group
    ranges = ranges.withColumns({"ahead": F.coalesce(F.sum("own").over(group.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("own").over(group)})
    inside = W.partitionBy(*by, "range").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("own").over(inside), F.lit(0)))
    both = _beside(placed, ranges, by, ["range"], ["ahead", "n"])
    return both.select(*by, "value", "own", (F.col("ahead") + F.col("inside")).alias("before"), "n")


def percentiles(rows: DataFrame, column: Column, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, a column for each share; a group without a value has no row."""
    by = by or []
    o = ordered(rows, column.cast("double"), by)
    picks = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("n") - 1)
        here = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("own")), F.col("value")))
        picks += [here(F.floor(at)).alias(f"{name}_low"), here(F.ceil(at)).alias(f"{name}_high"), F.max(at - F.floor(at)).alias(f"{name}_part")]
    g = o.groupBy(*by).agg(*picks)
    return g.select(*by, *[((1 - F.col(f"{n}_part")) * F.col(f"{n}_low") + F.col(f"{n}_part") * F.col(f"{n}_high")).alias(n) for n in shares])


def interval(samples: DataFrame, column: str = "mean", level: float = 0.95) -> DataFrame:
    """Percentiles with linear interpolation; null without samples."""
    a = (1 - level) / 2
    p = percentiles(samples, F.col(column), {"low": a, "high": 1 - a})
    return p.agg(F.max("low").alias("low"), F.max("high").alias("high"))  # a row in any case


def paired_differences(rows: DataFrame, document: str, chunker: str, system: str, seed: str, value: str, first: str = "B", second: str = "E") -> DataFrame:
    """By document, the mean over chunkers of second - first for each seed, and over all of them."""
    cells = rows.groupBy(document, chunker, seed).agg(F.avg(F.when(F.col(system) == second, F.col(value))).alias("y"), F.avg(F.when(F.col(system) == first, F.col(value))).alias("x")).where("x is not null and y is not null")
    return cells.groupBy(document, seed).agg(F.avg(F.col("y") - F.col("x")).alias("difference"))


def leave_one_out(effects: DataFrame, value: str = "effect") -> DataFrame:
    """For each row the mean of all others: (sum - x) / (n - 1)."""
    total = effects.agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return effects.crossJoin(F.broadcast(total)).withColumn("without", F.try_divide(F.col("total") - F.col(value), F.col("n") - 1)).drop("total", "n")


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """N, mean, min, median, p95 and max of the finite values; null where there are none."""
    by = by or []
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value).cast("double"))
    plain = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    exact = percentiles(rows, v, {"median": 0.5, "p95": 0.95}, by)
    both = plain.alias("r").join(exact.alias("g"), _same("r", "g", by), "left")
    return both.select(*[f"r.{c}" for c in by], "r.n", "r.mean", "r.min", "g.median", "g.p95", "r.max")


def argbest(rows: DataFrame, value: str, ties: list[Column], digits: int = 9) -> DataFrame:
    """The row of the highest value; ties by the columns in order."""
    return rows.orderBy(F.desc(F.round(value, digits)), *ties).limit(1)


def with_average_rank(rows: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """`rows` with the rank of the column's value in its group, ties at their mean; a null has none."""
    ranks = ordered(rows, F.col(column), by).select(*by, F.col("value").alias(column), (F.col("before") + (F.col("own") + 1) / 2).alias(name))
    return rows.alias("r").join(ranks.alias("g"), _same("r", "g", [*by, column]), "left").select("r.*", f"g.{name}")


def associations(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson and average-rank Spearman; null where a side is constant."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = with_average_rank(with_average_rank(r, x, by, "rx"), y, by, "ry")
    corr = lambda a, b: F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))  # noqa: E731  null where a side is constant
    return r.groupBy(*by).agg(F.count("*").alias("n"), corr(x, y).alias("pearson"), corr("rx", "ry").alias("spearman"))


def contrasts(rows: DataFrame, system: str, order: list[str], metrics: list[str]) -> DataFrame:
    """Second minus first of all pairs in the given order."""
    means = rows.groupBy(system).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("place", F.array_position(F.array(*[F.lit(s) for s in order]), F.col(system)))
    a, b = means.alias("a"), means.alias("b")
    return a.join(b, F.col("a.place") < F.col("b.place")).select(F.concat(F.col(f"b.{system}"), F.lit(" minus "), F.col(f"a.{system}")).alias("contrast"), *[(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(m) for m in metrics])
