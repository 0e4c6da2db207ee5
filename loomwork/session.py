"""Session settings and the few places where the driver looks at data."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # call-site capture costs several driver round trips per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks; a cluster job passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomwork")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; in local mode a temporary one where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.split("[")[0] == "local":
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that the driver and all executors share"
        )
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomwork-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize to replicated storage so that iterations survive the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: rows of whole texts that reach Python at once, and rows that leave it at once
BATCH_ROWS = 256
OUT_ROWS = 10_000


def small_batches(df: DataFrame) -> DataFrame:
    """The table, with a session whose whole texts reach Python few at a time."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that functions inside it load there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loomwork-package-"), "loomwork.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)  # read by the driver only, which serves it to the executors
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over as many tasks as the session has cores.

    For work that is heavy per row, on inputs that arrive as one or two small files; a scan
    with enough splits of its own is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
