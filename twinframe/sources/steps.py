"""Written steps: tables in the folder that all executors share, which cut a lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in a local session that has none, a folder of its own."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
    return _own_folder(spark.sparkContext.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/twinframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_STEPS: dict[int, tuple[weakref.ref, str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df, from Parquet in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    step = spark.read.schema(df.schema).parquet(path)
    _STEPS[id(step)] = (weakref.ref(step), path)
    return step


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*steps: DataFrame) -> None:
    """Delete the files of written steps that no later job reads: what was made of them has been written itself."""
    for step in steps:
        known, path = _STEPS.pop(id(step), (None, None))
        if known is not None and known() is step:
            _delete(step.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all steps of this application, once its results have been read or written elsewhere."""
    _delete(spark, f"{shared_folder(spark)}/twinframe/{spark.sparkContext.applicationId}")
