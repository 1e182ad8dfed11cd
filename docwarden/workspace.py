"""Where what a stream writes goes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def work_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, deleted when the session's JVM ends."""
    path = f"{work_dir(spark)}/{what}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local session without one gets a
    temporary folder; on a cluster executors could not share it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="docwarden-"))
    return _local[0]
