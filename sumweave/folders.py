"""Folders that the driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used in local mode where spark.checkpoint.dir is unset, as in tests.
TEST_FOLDER = "/tmp/checkpoints"


def new_folder(spark: SparkSession, local: bool = False) -> str:
    """A new folder below spark.checkpoint.dir, removed when Spark ends; local: as a path for open(), made at once. A
    cluster must name the folder that it shares."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset; it names the folder that the driver and all executors share")
    path = f"{(top or TEST_FOLDER).rstrip('/')}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p)
    if local:
        fs.mkdirs(p)
        return path.removeprefix("file://").removeprefix("file:")
    return path
