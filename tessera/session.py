"""Session helpers: sane defaults for SQL workloads and reliable lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tessera", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, named by a cluster in ``spark.checkpoint.dir``.

    Only a single machine may do without: it gets a temporary folder. Any other
    master raises, since its executors could not read each other's files.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = at or tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(at)
    return at


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new path in the shared folder, deleted at the end."""
    at = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield at
    finally:
        drop(spark, at)


def drop(spark: SparkSession, at: str) -> None:
    """Delete a path of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Have the driver drop what nothing refers to any more, so that the files of shuffles that are over go at once."""
    spark.range(1).count()  # the listener bus holds on to the last query until another one ends
    gc.collect()
    spark.sparkContext._jvm.System.gc()
