"""Session settings, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted up to this bound.
BROADCAST_ROWS = 500_000


def get_session(app: str = "airgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; keyword arguments override them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the session.

    It is the one named by ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder; a cluster session without it is refused, because a folder on one machine does
    not survive the loss of that machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` out, count it, and hint a broadcast when it holds at most ``max_rows`` rows.

    Writing first means the plan behind ``df`` runs once. Above the bound the written copy carries no
    hint, so the join shuffles both sides and adaptive execution splits skewed keys.
    """
    written = reliable_checkpoint(df)
    counted = written.limit(max_rows + 1).count()
    return F.broadcast(written) if counted <= max_rows else written


def require_columns(df: DataFrame, names, what: str = "table") -> None:
    """Raise when a required column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing: {', '.join(missing)}")
