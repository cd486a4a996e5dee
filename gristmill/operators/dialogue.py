"""Dialogues to cases and title families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns that an inference table must not have.
EVALUATION_ONLY = ("target_agent_response", "grounding_annotations", "gold_document_metadata", "rc_answer")


def _order():
    return W.partitionBy("conv_id").orderBy("turn")


def transitions(turns: DataFrame, user: str = "user", agent: str = "agent") -> DataFrame:
    """User turns followed directly by an agent turn, with that turn's text as `target`. Roles match in any case."""
    next_of = turns.withColumns({"next_role": F.lead("role").over(_order()), "target": F.lead("text").over(_order())})
    return next_of.where((F.lower("role") == user) & (F.lower("next_role") == agent)).drop("next_role")


def query_text(history: Column) -> Column:
    """A line `ROLE: text` for each turn of an array<struct<role, text>>."""
    return F.array_join(F.transform(history, lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"])), "\n")


def histories(turns: DataFrame) -> DataFrame:
    """Each turn with the array of all turns up to it and the query text."""
    upto = _order().rowsBetween(W.unboundedPreceding, W.currentRow)
    h = turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(upto))
    return h.withColumn("retrieval_query", query_text(F.col("history")))


def cases(turns: DataFrame, user: str = "user", agent: str = "agent") -> DataFrame:
    """P20: a row for each transition: history through the user's turn, query and target."""
    h = histories(turns).withColumns({"next_role": F.lead("role").over(_order()), "target_agent_response": F.lead("text").over(_order())})
    return h.where((F.lower("role") == user) & (F.lower("next_role") == agent)).select("conv_id", "turn", "history", "retrieval_query", "target_agent_response")


def inference(rows: DataFrame) -> DataFrame:
    """The columns that a model may see; refuses tables from which an evaluation column would leak."""
    out = rows.drop(*EVALUATION_ONLY)
    leaked = {f for f in EVALUATION_ONLY if f in str(out.schema.jsonValue())}
    if leaked:
        raise ValueError(f"evaluation columns in inference rows: {sorted(leaked)}")
    return out


def one_per(rows: DataFrame, group: str, identity: Column, salt: str) -> DataFrame:
    """D11, by a rule of our own: of each group the row whose salted hash is smallest."""
    return rows.withColumn("selection_hash", F.sha2(F.concat(F.lit(salt + "|"), identity), 256)).groupBy(group).agg(F.min_by(F.struct(*[c for c in rows.columns if c != group], "selection_hash"), "selection_hash").alias("r")).select(group, "r.*")


def family_key(domain: Column, title: Column, spaced: bool = False) -> Column:
    """P5: domain :: lower-case title without a trailing number sign and digits; P6 (`spaced`): only after white space."""
    name = F.regexp_replace(F.trim(F.lower(title)), r"\s+#\d+$" if spaced else r"\s*#\d+$", "")
    return F.concat(F.trim(F.lower(domain)), F.lit("::"), F.trim(F.regexp_replace(name, r"\s+", " ")))
