"""The folder that driver and executors share, for files and tables that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new local one only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if found is None and current.isDefined():
        found = current.get()
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomseq-")
    if not current.isDefined():
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
