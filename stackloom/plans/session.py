"""Making this package known to Python workers, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless their PYTHONPATH has it already."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="stackloom-")
    sc.addPyFile(shutil.make_archive(f"{folder}/stackloom", "zip", ROOT, "stackloom"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables: spark.checkpoint.dir, or else the one set on the context.

    In local mode, where all tasks share one machine, a temporary folder is taken if none is set. On a cluster that
    would put parts of a table on separate machines, so it is an error there.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return Path(tempfile.mkdtemp(prefix="stackloom-")).as_uri()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there; a folder is set only where none is."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def table_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables, below the folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
