"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pathlark-")
        delete_on_exit(spark, found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
        delete_on_exit(spark, sc.getCheckpointDir())
    return found


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Has a folder, made if need be, deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table between two steps. It is deleted when the driver ends, as results may read it until then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return f"{path}/table"
