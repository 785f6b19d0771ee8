"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A private one is made only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    return _own[application]


def materialize(df: DataFrame, codec: str = "zstd", most: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.  ``most``
    bounds the rows of one written file, where rows are very long.

    The files go when the application's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("maxRecordsPerFile", most).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
