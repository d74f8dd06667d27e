"""Tables between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths written by ``store``, by application.
STORED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; on one machine a temporary one if none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: this job needs a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="lumenlog-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, so lost executors cost no rerun."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Removes what this application stored; call it when no result is read any more."""
    paths = STORED.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    return len(paths)
