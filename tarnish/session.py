"""Session settings, and the folder that driver and executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Used where no shared folder is named and all runs on one machine.
LOCAL_DIR = "/tmp/checkpoints"
_shipped: set[str] = set()


def on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_root(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; without it a local one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not on_one_machine(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_DIR).rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable for the Python workers: on one machine by their path, on a cluster as a zip file that executors fetch."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, env = os.path.dirname(package), spark.sparkContext.environment
    if on_one_machine(spark):
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
        return
    if spark.sparkContext.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp()  # of the driver, which serves the file
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tarnish-package"), "zip", root, os.path.basename(package)))
    _shipped.add(spark.sparkContext.applicationId)


def local_session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A session for tests and small runs; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("tarnish")
        .config("spark.sql.shuffle.partitions", str(partitions or cores)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").getOrCreate()
    )
