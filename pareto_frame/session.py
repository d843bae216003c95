"""Shared storage and lineage cuts.

Phases whose size decides how the next phase runs are written to the
checkpoint folder once. That gives their exact size, stops the expensive part
upstream from running again, and survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints, as named by ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may go without the setting; a
    cluster needs storage that every executor can reach.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        # checkpoints and stored tables belong in one place, so the setting wins over an earlier folder
        if current is None or named.rstrip("/") not in current:
            context.setCheckpointDir(named)
        return named
    if current is None:
        # local-cluster has executors of its own, so only plain local masters count
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to storage shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pareto-frame-"))
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_PLANNING = threading.Lock()
# of each session, how many calls are planning, and the setting before the first of them
_DERIVING_OFF: dict[str, tuple[int, str]] = {}


@contextmanager
def no_derived_constraints(spark: SparkSession):
    """Plan without deriving conditions from conditions.

    A condition over all of many dimensions, renamed one by one, would be derived in every
    combination of old and new names, which takes longer than any query. The setting belongs to the
    session, so of several threads the last one to finish restores it.
    """
    key, name = "spark.sql.constraintPropagation.enabled", spark._jsparkSession.sessionUUID()
    with _PLANNING:
        calls, before = _DERIVING_OFF.get(name, (0, spark.conf.get(key)))
        _DERIVING_OFF[name] = calls + 1, before
        spark.conf.set(key, "false")
    try:
        yield
    finally:
        with _PLANNING:
            calls, before = _DERIVING_OFF.pop(name)
            if calls > 1:
                _DERIVING_OFF[name] = calls - 1, before
            else:
                spark.conf.set(key, before)


@dataclass(frozen=True)
class Phase:
    """A checkpointed intermediate result, its exact number of rows, and of those that are marked.

    ``text_bytes``: what its texts take, where that has been counted.
    """

    rows: DataFrame
    count: int
    marked: int = 0
    text_bytes: int | None = None


_PHASES: ContextVar[list | None] = ContextVar("phases", default=None)


@contextmanager
def recorded_phases():
    """The names and exact sizes of the phases that are stored within the block, in order."""
    found: list[tuple[str, int]] = []
    token = _PHASES.set(found)
    try:
        yield found
    finally:
        _PHASES.reset(token)


def materialise(df: DataFrame, marked: str | None = None, phase: str | None = None) -> Phase:
    """Checkpoint ``df`` and count it, and the rows where column ``marked`` is true, in the same job.

    A named ``phase`` goes into the record of ``recorded_phases``, less the marked rows.
    """
    shared_folder(df.sparkSession)
    seen = Observation()
    true = F.col(marked) if marked else F.lit(False)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    widths = [F.coalesce(F.octet_length("`" + c.replace("`", "``") + "`"), F.lit(0)).cast("long") for c in texts]
    counts = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(true).alias("marked"),
        F.sum(sum(widths, F.lit(0).cast("long"))).alias("text_bytes"),
    ]
    kept = df.observe(seen, *counts).checkpoint()
    found = Phase(kept, *[int(seen.get[c] or 0) for c in ("n", "marked", "text_bytes")])
    record = _PHASES.get()
    if phase and record is not None:
        record.append((phase, found.count - found.marked))
    return found
