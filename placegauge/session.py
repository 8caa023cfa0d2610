"""Session set-up for applications and tests; library functions never change a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Split a hot join key even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Capturing the Python line of every column call costs more than building these plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "placegauge", master: str | None = None, **extra: str):
    """A session with the settings this library is written for.

    ``spark.checkpoint.dir`` is left to the cluster: it names the shared folder there.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str | None:
    """Folder for reliable checkpoints: the context's own, else what the session names."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    return named


def require_checkpoint_folder(spark: SparkSession) -> None:
    """Make reliable checkpoints possible: where no folder is named, beside the tables.

    The warehouse is shared by driver and executors like ``spark.checkpoint.dir``.
    """
    if not checkpoint_folder(spark):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the checkpoint folder.

    For tables that several branches of a plan read: the work above is done once, and a lost
    executor costs a re-read instead of a recomputation.
    """
    require_checkpoint_folder(df.sparkSession)
    return df.checkpoint()
