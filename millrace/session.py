"""Session settings and the shared folder used for checkpoints and hand-over files."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a temporary folder: on a
    cluster an executor's own disk vanishes with the executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        current = context.getCheckpointDir()
    return os.path.dirname(current.rstrip("/"))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_kept: ContextVar[list[DataFrame] | None] = ContextVar("kept", default=None)


def keep(df: DataFrame) -> DataFrame:
    """Persists a table that several jobs read; released at the end of the running scope.

    Cached blocks lost with an executor are recomputed from the lineage.
    """
    held = _kept.get()
    if held is not None:
        held.append(df)
    return df.persist()


@contextmanager
def scope() -> Iterator[None]:
    """Releases what :func:`keep` persisted inside, for callers that finish their actions here."""
    held: list[DataFrame] = []
    token = _kept.set(held)
    try:
        yield
    finally:
        _kept.reset(token)
        for df in held:
            df.unpersist()
