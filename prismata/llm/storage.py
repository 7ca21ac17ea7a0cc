"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a local session (tests, a laptop) names none is a local folder
    set; on a cluster its executors would not see each other's files, so that
    is an error.
    """
    found = spark.conf.get(SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{SETTING} is not set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prismata-shared-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/prismata-{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends at files that survive the loss of any executor, and what
    was computed is not computed again by each later reader.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._prismata_path = path
    return held


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: all that was made of them is written."""
    for df in tables:
        _delete(df.sparkSession, df._prismata_path)


def release(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder, when the results made of it are no longer read."""
    _delete(spark, f"{shared_dir(spark)}/prismata-{spark.sparkContext.applicationId}")
