"""A session with the settings the operators expect."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, no UI; partitions stay the cluster's unless given."""
    builder = SparkSession.builder.appName("helixframe").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started: by path, and beyond one machine as a zip."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
        if not sc.master.startswith("local"):
            to = os.path.join(tempfile.mkdtemp(), "helixframe")
            sc.addPyFile(shutil.make_archive(to, "zip", root, "helixframe"))
    return spark
