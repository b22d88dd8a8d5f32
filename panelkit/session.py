"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "panelkit") -> SparkSession:
    """Session with AQE (coalescing + skew join) and UTC.

    Master and shuffle partitions are the cluster's own unless asked for here
    (or by PANELKIT_MASTER, PANELKIT_SHUFFLE_PARTITIONS); checkpoint files go
    when nothing refers to them any more.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    settings = {"spark.sql.shuffle.partitions": shuffle_partitions or os.environ.get("PANELKIT_SHUFFLE_PARTITIONS"),
                "spark.driver.memory": os.environ.get("PANELKIT_DRIVER_MEMORY")}
    for key, value in settings.items():
        if value:
            builder = builder.config(key, str(value))
    master = master or os.environ.get("PANELKIT_MASTER")
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (as ``--py-files`` would), for
    functions that run in Python workers."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="panelkit-ship-"), "panelkit.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present (a shared file system path).  Only
    a local-mode session without it (tests, laptops) gets a fresh folder, which
    the Spark context remembers (the setting itself can't be changed later).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="panelkit-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
