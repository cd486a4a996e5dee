"""Retrieval-experiment analytics on Spark: DataFrame and Column functions planned by Catalyst."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

_own: dict[str, str] = {}


def importable(spark) -> None:
    """Let Python workers that this session starts import this package from where the driver has it, and have small batches.

    On a cluster where the package is installed, or sent with --py-files, the first changes nothing.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    bounded_batches(spark)


#: Bytes of a batch to Python: texts may be long, and a worker and the JVM hold a batch several times over.
BATCH_BYTES = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark) -> None:
    """Let batches to Python have about BATCH_BYTES at most.

    Plans read this setting when they are made, after the operator has returned, so it stays; it is only ever lowered, and
    changes no result.
    """
    own = spark.conf.get(_BYTES, None)
    if not own or not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def shared_dir(spark) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, as in tests, one made for this application."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="gristmill-")
    return _own[app]
