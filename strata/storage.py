"""The folder that driver and executors share, for data between two jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A name for a new folder in the place that driver and executors share, deleted when the driver's JVM ends; a local one only where none is
    set and there is one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = spark.conf.get("spark.strata.shared.dir", None)
        if not known:
            known = f"file://{tempfile.mkdtemp(prefix='strata-shared-')}"
            spark.conf.set("spark.strata.shared.dir", known)
    known = known if "://" in known or known.startswith("file:") else f"file://{known}"
    folder = f"{known.rstrip('/')}/arrays-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in a shared folder, so that it is made once and outlives the executors that made it."""
    folder = shared_folder(df.sparkSession) + "/table"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
