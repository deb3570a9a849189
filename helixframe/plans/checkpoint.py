"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or our own where a local session has none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, at, True)
        sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_stored: dict[str, SparkSession] = {}


def drop_stored() -> None:
    """Deletes the tables that ``cut`` stored in this process; DataFrames that read them end with that."""
    while _stored:
        path, spark = _stored.popitem()
        with contextlib.suppress(Exception):  # the session's JVM may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


atexit.register(drop_stored)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a table and read from there.

    A checkpoint would keep constraints and size estimates of the plan it cuts: both multiply with each round of an
    iteration, until planning takes longer than the work and no small side is known to be small. A table has its true size.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{spark.sparkContext.applicationId}"
    _stored[folder] = spark
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
