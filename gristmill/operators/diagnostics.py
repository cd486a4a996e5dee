"""Rankings of several systems over one pool, and what they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import normalize_text

# The systems in order, the seeds and the number of contexts.
SYSTEMS = ("H", "U", "B", "E")
SEEDS = (20260904, 20260905, 20260906)
TOP = 4


def instances() -> list[tuple[str, str, int | None]]:
    """(instance, system, seed): the fused order and the unadapted scorer have no seed, the adapted ones three."""
    return [("H", "H", None), ("U", "U", None), *((f"{s}_{seed}", s, seed) for s in ("B", "E") for seed in SEEDS)]


def rank_systems(scored: DataFrame, cell: list[str]) -> DataFrame:
    """Rows (instance, cell, chunk_id, fused_rank, score) to ranks by (-score, fused_rank, chunk_id) in each cell."""
    order = W.partitionBy("instance", *cell).orderBy(F.desc("score"), "fused_rank", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order))


def top_lists(ranked: DataFrame, by: list[str], k: int = TOP) -> DataFrame:
    """O2: the first k chunks in order, as an array."""
    return ranked.where(F.col("rank") <= k).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("t")).select(*by, F.col("t.chunk_id").alias("top"))


def overlap(a: Column, b: Column, k: int = TOP) -> dict[str, Column]:
    """The share of the k that both hold, Jaccard, and whether order or set are equal."""
    shared = F.size(F.array_intersect(a, b))
    return {
        "intersection_fraction": shared / F.lit(k),
        "jaccard": shared / F.size(F.array_union(a, b)),
        "identical_order": a == b,
        "identical_set": F.sort_array(a) == F.sort_array(b),
    }


def evidence_flow(spans: Column, pool: Column, selected: Column, packed: Column, pool_grades: Column, selected_grades: Column) -> dict[str, Column]:
    """Spans, pool and selected are arrays of normalised texts, packed one normalised text.

    Literal spans in the pool, among the selected and in the packed context; those selected and lost in packing; and the share of grade 2
    that was selected, null where the pool has none.
    """
    in_any = lambda texts: F.filter(spans, lambda s: F.exists(texts, lambda t: F.contains(t, s)))
    in_packed = F.filter(spans, lambda s: F.contains(packed, s))
    two = lambda grades: F.size(F.filter(grades, lambda g: g == 2))
    return {
        "annotated_spans": F.size(spans),
        "pool_spans": F.size(in_any(pool)),
        "selected_spans": F.size(in_any(selected)),
        "packed_spans": F.size(in_packed),
        "lost_in_packing": F.size(F.array_except(in_any(selected), in_packed)),
        "grade2_recall": F.try_divide(two(selected_grades).cast("double"), two(pool_grades)),
    }


def spans_of(texts: Column) -> Column:
    """The distinct, non-empty normalised spans, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(texts, lambda t: normalize_text(t)), lambda t: t != "")))


def availability(pools: DataFrame, by: list[str]) -> DataFrame:
    """Cells, those without any grade 2 and without any grade of 1 or more."""
    cells = pools.groupBy(*by).agg(F.count_if(F.col("grade") == 2).alias("two"), F.count_if(F.col("grade") >= 1).alias("one"))
    return cells.agg(F.count("*").alias("n_cells"), F.count_if(F.col("two") == 0).alias("zero_grade2"), F.count_if(F.col("one") == 0).alias("zero_grade_ge1"))


def finite(c: Column) -> Column:
    """Null in place of a number that isn't finite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ordering(rows: DataFrame, by: list[str], system: str, metrics: list[str]) -> DataFrame:
    """The systems by falling mean of each metric in each group, and whether the first metric orders them as the last does."""
    means = rows.groupBy(*by, system).agg(*[F.round(F.avg(m), 9).alias(m) for m in metrics])
    orders = [F.transform(F.sort_array(F.collect_list(F.struct((-F.col(m)).alias("minus"), F.col(system).alias("s")))), lambda x: x["s"]).alias(f"by_{m}") for m in metrics]
    return means.groupBy(*by).agg(*orders).withColumn("changed", F.col(f"by_{metrics[0]}") != F.col(f"by_{metrics[-1]}"))
