"""Written intermediates: tables that several branches of a plan read are written once to
the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session on one machine (tests) gets a folder of its own
    where that is unset; on a cluster, whose executors would not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _clean(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has been stopped; the folder's owner cleans up
        pass


_USED: set[str] = set()


def fresh_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder, which goes when the process ends."""
    folder = f"{shared_folder(spark)}/lexiquarry/{spark.sparkContext.applicationId}"
    if folder not in _USED:
        _USED.add(folder)
        atexit.register(_clean, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def staged(frame: DataFrame) -> DataFrame:
    """``frame`` written and read back; a lost executor costs a re-read. The files go when
    the process ends."""
    spark = frame.sparkSession
    path = fresh_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
