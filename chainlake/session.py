"""

The engine never creates a cluster of its own: on a real deployment the
session comes from the cluster and only the SQL options below are applied.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# SQL behaviour the extraction and the oracles rely on.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # No broadcast is forced on data of unknown size; the automatic threshold
    # stays at its default.
}

# When on, the shuffle files of a query go as it ends, not when the driver's
# next collection of garbage finds them unused.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside leave no shuffle files behind; the session's setting is
    as before afterwards."""
    had = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, had)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "chainlake") -> SparkSession:
    """Local/test session builder. On a cluster, pass the existing session to
    :func:`configure` instead."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder.config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("CHAINLAKE_DRIVER_MEMORY", "8g"))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in SQL_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Prepare a caller's session: block times are read in UTC, and a
    checkpoint folder must exist. No other setting of the session changes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read.
    When it is unset, a fresh scratch folder is created and registered, in
    local mode only (tests); executors of a cluster would each see a folder of
    their own, so there it is an error.
    """
    global _LOCAL_CKPT
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if sc_dir.isDefined():
            path = sc_dir.get()
        else:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            if _LOCAL_CKPT is None:
                _LOCAL_CKPT = tempfile.mkdtemp(prefix="chainlake-ckpt-")
            path = _LOCAL_CKPT
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:
            pass
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


_LOCAL_CKPT: str | None = None
