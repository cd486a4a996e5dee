"""An event log, the sessions in it against a ceiling, and gates."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.sources.jsonl import canonical_text, write_json

RECOVERY_SECONDS = 60.0


def utc_text(c: Column) -> Column:
    """ISO-8601 with Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_utc_text(c: Column) -> Column:
    return F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ssX")


def allocated(sessions: DataFrame, margin: float = RECOVERY_SECONDS) -> DataFrame:
    """Sessions (started, heartbeat, ended) with allocated seconds; one that never ended counts to its last heartbeat plus the margin."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    end = F.coalesce(seconds("ended"), seconds("heartbeat") + margin)
    return sessions.withColumns({"allocated_seconds": F.greatest(F.lit(0.0), end - seconds("started")), "recovered": F.col("ended").isNull()})


def cumulative(sessions: DataFrame, by: list[str], order: list[str], ceiling: float) -> DataFrame:
    """Running sums by group and whether they pass the ceiling."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    micros = F.round(F.col("allocated_seconds") * 1e6).cast("long")  # whole numbers, so that the sum doesn't hang on the order
    return sessions.withColumn("cumulative_seconds", F.sum(micros).over(w) / 1e6).withColumns({"remaining_seconds": F.greatest(F.lit(0.0), F.lit(ceiling) - F.col("cumulative_seconds")), "over": F.col("cumulative_seconds") > ceiling})


def moving_rate(rows: DataFrame, by: list[str], order: list[str], value: str, last: int = 20) -> DataFrame:
    """The mean of the last `last` values."""
    return rows.withColumn("recent", F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-(last - 1), 0)))


class BudgetStop(RuntimeError):
    """Raised where the projected total passes the ceiling."""


class EventLog:
    """An append-only file of JSON lines, a line for each event; nothing that is written is changed."""

    SCHEMA = "id string, at double, stage string, event string, session string, details map<string, string>"

    def __init__(self, path: Path, clock: Callable[[], float] = time.time) -> None:
        self.path, self.clock = path, clock

    def write(self, stage: str, event: str, session: str | None = None, **details: object) -> dict:
        row = {"id": uuid.uuid4().hex, "at": self.clock(), "stage": stage, "event": event, "session": session, "details": {k: str(v) for k, v in details.items()}}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a", encoding="utf-8") as lines:
            lines.write(canonical_text(row) + "\n")
        return row

    def read(self, spark: SparkSession) -> DataFrame:
        if not self.path.exists():
            return spark.createDataFrame([], self.SCHEMA)
        return spark.read.schema(self.SCHEMA).json(str(self.path))


def sessions_of(events: DataFrame, by: list[str], at: str = "at") -> DataFrame:
    """Of events with a kind in `event`, the sessions: when each started, was last heard of and, where it says `end`, ended."""
    return events.groupBy(*by).agg(F.min(at).alias("started"), F.max(at).alias("heartbeat"), F.max(F.when(F.col("event") == "end", F.col(at))).alias("ended"))


class Budget:
    """The time that the sessions of an event log have used against a ceiling.

    Only events are stored. What is used is asked of them each time: a session without an end counts to its last event plus
    the margin, this one to its last event.
    """

    def __init__(self, spark: SparkSession, log: EventLog, ceiling: float) -> None:
        self.spark, self.log, self.ceiling, self.session = spark, log, float(ceiling), None

    def used(self) -> float:
        told = sessions_of(self.log.read(self.spark).where("session is not null"), ["session"])
        current = told.withColumn("ended", F.when(F.col("session") == F.lit(self.session or ""), F.coalesce("ended", "heartbeat")).otherwise(F.col("ended")))
        return allocated(current).agg(F.coalesce(F.sum("allocated_seconds"), F.lit(0.0)).alias("s")).first().s

    def start(self, stage: str) -> float:
        others = self.log.read(self.spark).where(F.col("details")["ceiling"] != str(self.ceiling))
        if not others.isEmpty():
            raise RuntimeError("the log has sessions under another ceiling")
        self.session = uuid.uuid4().hex
        self.log.write(stage, "start", self.session, ceiling=self.ceiling)
        return self.used()

    def beat(self, stage: str, projected: float = 0.0) -> float:
        """What is used so far; stops the stage where that and what is projected pass the ceiling."""
        self._tell(stage, "beat")
        total = self.used() + projected
        if total > self.ceiling:
            raise BudgetStop(f"{total:.1f} s pass the ceiling of {self.ceiling:.1f} s")
        return total - projected

    def end(self, stage: str, status: str = "done") -> float:
        self._tell(stage, "end", status=status)
        self.session = None
        return self.used()

    def _tell(self, stage: str, event: str, **details: object) -> None:
        if self.session is None:
            raise RuntimeError("no session has started")
        self.log.write(stage, event, self.session, **details)


def gate(required: dict[Path, str], forbidden: list[Path] = ()) -> None:
    """T4: files that must have these hashes, and outputs of later stages that must not exist yet."""
    for path, sha in required.items():
        if not path.is_file() or hashlib.sha256(path.read_bytes()).hexdigest() != sha:
            raise RuntimeError(f"{path} isn't the file it should be")
    early = [str(p) for p in forbidden if p.exists()]
    if early:
        raise RuntimeError(f"outputs of a later stage exist: {early}")


def run_stage(name: str, work: Callable[[], object], failures: Path) -> object:
    """T5: what stops a stage is written to a file of its kind and raised again."""
    try:
        return work()
    except Exception as error:
        kind = "BUDGET_STOP" if isinstance(error, BudgetStop) else "BLOCKED"
        write_json(failures / f"{kind}.json", {"stage": name, "error": type(error).__name__, "message": str(error)})
        raise
