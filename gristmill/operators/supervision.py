"""Candidates to training groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import normalize_text

# The chunkers in their order.
CHUNKERS = ("fixed_128", "fixed_254", "recursive_254", "sentence_254")


def chunker_index(c: Column | str = "chunker") -> Column:
    """O3: the place in the list; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in CHUNKERS]), F.col(c) if isinstance(c, str) else c)
    return F.when(at == 0, len(CHUNKERS)).otherwise(at - 1).cast("int")


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    w = W.partitionBy("query_id", "norm").orderBy(*order)
    return rows.withColumn("norm", normalize_text("text")).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "norm")


def dedup_label_blind(rows: DataFrame) -> DataFrame:
    """One row for each query and normalised text, the smallest (rank, chunker name, chunk, document, hash); empty texts stay.

    No grade is read, so flipped grades select the same rows.
    """
    identity = F.sha2(F.concat_ws("\x1f", F.col("query_id").cast("string"), "chunk_id", "text"), 256)
    return _first(rows, F.col("fused_rank"), F.col("chunker"), F.col("chunk_id"), F.col("doc_id"), identity)


def dedup_grade_first(rows: DataFrame) -> DataFrame:
    """Prefers the higher grade, then rank, chunker's place and chunk; texts that normalise to nothing go."""
    return _first(rows.where(normalize_text("text") != ""), F.desc("grade"), F.col("fused_rank"), chunker_index(), F.col("chunk_id"))


def listwise_groups(rows: DataFrame, max_negatives: int = 7) -> DataFrame:
    """D3: a group for each row of a query's top grade above 0; negatives are the first lower-graded rows by (rank, chunk).

    Queries whose top grade is 0 or that have no lower grade give none.
    """
    if max_negatives <= 0:
        raise ValueError("max_negatives must be positive")
    top = rows.withColumn("top", F.max("grade").over(W.partitionBy("query_id"))).where("top > 0")
    by_rank = W.partitionBy("query_id").orderBy("fused_rank", "chunk_id")
    negatives = top.where("grade < top").withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= max_negatives)
    negatives = negatives.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "chunk_id", "text"))).alias("n"))
    positives = top.where("grade = top").select("query_id", F.col("grade").alias("positive_grade"), F.col("chunk_id").alias("positive_chunk_id"), F.col("text").alias("positive_text"))
    return positives.join(negatives, "query_id").select("query_id", "positive_grade", "positive_chunk_id", "positive_text", F.col("n.chunk_id").alias("negative_chunk_ids"), F.col("n.text").alias("negative_texts"))


def prune_pairs(groups: DataFrame, positive_length: Column, negative_lengths: Column, max_length: int = 512) -> DataFrame:
    """Lengths are tokens of the rendered pairs. A positive over the limit excludes its group, negatives over it go,
    and a group without any left is excluded, each with its reason."""
    g = groups.withColumns({"positive_length": positive_length, "negative_lengths": negative_lengths})
    kept = F.filter(F.arrays_zip("negative_chunk_ids", "negative_lengths"), lambda x: x["negative_lengths"] <= max_length)
    g = g.withColumn("kept", kept)
    reason = F.when(F.col("positive_length") > max_length, "overlength_positive_pair").when(F.size("kept") == 0, "no_surviving_negative_pair")
    return g.withColumns({"reason": reason, "status": F.when(reason.isNull(), "retained").otherwise("excluded"), "kept_chunk_ids": F.when(reason.isNull(), F.col("kept.negative_chunk_ids")), "pair_token_counts": F.when(reason.isNull(), F.concat(F.array("positive_length"), F.col("kept.negative_lengths")))}).drop("kept")


def sequence(positive: Column, negatives: Column) -> Column:
    """The positive first, then the negatives."""
    return F.concat(F.array(positive), negatives)


def positive_first(labels: Column) -> Column:
    """A group of two or more with label 1 at the start and 0 elsewhere."""
    return (F.size(labels) >= 2) & (F.get(labels, F.lit(0)) == 1) & F.forall(F.slice(labels, 2, F.size(labels)), lambda x: x == 0)


def collate(groups: DataFrame, group: str, texts: Column, lengths: Column, max_length: int = 512) -> DataFrame:
    """Groups to rows (group, position, label, text, length); a length over the limit fails the query."""
    flat = groups.select(group, F.posexplode(F.arrays_zip(texts.alias("text"), lengths.alias("length"))).alias("position", "x"))
    length = F.when(F.col("x.length") > max_length, F.raise_error(F.lit("pair over the length limit"))).otherwise(F.col("x.length"))
    return flat.select(group, "position", (F.col("position") == 0).cast("int").alias("label"), F.col("x.text").alias("text"), length.alias("length"))


def listwise_loss(rows: DataFrame, group: str, position: str = "position", score: str = "score") -> DataFrame:
    """Minus log softmax of the positive, at position 0, of each group of two or more; the mean over groups is the loss."""
    top = rows.groupBy(group).agg(F.max(score).alias("top"))
    s = rows.join(top, group).groupBy(group).agg(F.first("top").alias("top"), F.sum(F.exp(F.col(score) - F.col("top"))).alias("z"), F.max(F.when(F.col(position) == 0, F.col(score))).alias("positive"), F.count("*").alias("size"))
    return s.select(group, "size", F.when(F.col("size") < 2, F.raise_error(F.lit("a group needs a negative"))).otherwise(F.log("z") + F.col("top") - F.col("positive")).alias("loss"))


def epoch_draws(groups: DataFrame, group: str, draws: int, seed: int) -> DataFrame:
    """Whole permutations of the groups, epoch by epoch, until `draws` are made.

    An epoch's order is by md5 of (seed + 1000003 x epoch, group). Epochs are drawn side by side, each in a window of its own.
    """
    count = groups.count()
    if count <= 0 or draws < 0:
        raise ValueError("Invalid group/draw count")
    epochs = groups.sparkSession.range(-(-draws // count)).select(F.col("id").alias("epoch"))
    every = groups.select(group).crossJoin(F.broadcast(epochs))
    order = W.partitionBy("epoch").orderBy(F.md5(F.concat_ws("|", (F.lit(seed) + F.lit(1_000_003) * F.col("epoch")).cast("string"), F.col(group).cast("string"))), group)
    placed = every.withColumn("place", F.row_number().over(order) - 1)
    return placed.withColumn("draw", F.col("epoch") * count + F.col("place")).where(F.col("draw") < draws).select("draw", "epoch", group)


def convert_groups(groups: DataFrame, method: str, instruction: str) -> DataFrame:
    """Groups of D3 to flat training records: an id hashed from the method and the source, the positive and the negatives as structs."""
    source = F.sha2(F.concat_ws("\x1f", F.col("query_id").cast("string"), "positive_chunk_id", F.array_join("negative_chunk_ids", "\x1e")), 256)
    pairs = F.arrays_zip(F.col("negative_chunk_ids").alias("chunk_id"), F.col("negative_texts").alias("text"))
    return groups.select(
        F.sha2(F.concat(F.lit(method + "|"), source), 256).alias("group_id"),
        "query_id",
        F.lit(method).alias("method"),
        F.lit(instruction).alias("instruction"),
        F.struct(F.col("positive_chunk_id").alias("chunk_id"), F.col("positive_text").alias("text"), F.lit(1).alias("label"), F.col("positive_grade").alias("source_grade")).alias("positive"),
        F.transform(pairs, lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"), F.lit(0).alias("label"))).alias("negatives"),
        source.alias("source_sha256"),
    )


def job_matrix(spark, dims: dict[str, list]) -> DataFrame:
    """A row for each combination of stated values, with an id made of them."""
    out = None
    for name, values in dims.items():
        own = spark.createDataFrame([(v,) for v in values], [name]).coalesce(1)
        out = own if out is None else out.crossJoin(own)
    return out.select(F.concat_ws("_", *[F.col(n).cast("string") for n in dims]).alias("job_id"), *dims)
