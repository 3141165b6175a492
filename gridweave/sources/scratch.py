"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own where that is unset and all tasks run on this machine."""
    global _own_root
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="gridweave-")
        atexit.register(shutil.rmtree, _own_root, True)
    return f"file://{_own_root}"


def persisted(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage.

    A lost executor then costs a task that rereads files, not the stages above.
    Tables stay in a folder of the application until cleared() is called, as a
    result may still be read from them.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/gridweave/{spark.sparkContext.applicationId}"


def cleared(spark: SparkSession) -> None:
    """Deletes the application's intermediate tables, once no result that rests on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
