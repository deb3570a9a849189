"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or one of our own in a local session without it."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Actions within use Arrow batches of at most that many rows: wide rows' buffers lie outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


_tables: dict[str, SparkSession] = {}


def drop_tables() -> None:
    """Deletes the tables that this process stored in shared folders; DataFrames that read them end with that."""
    while _tables:
        path, spark = _tables.popitem()
        with contextlib.suppress(Exception):  # the session's JVM may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


atexit.register(drop_tables)


def tables_folder(spark: SparkSession) -> str:
    """The folder of the tables that this application stores, which ``drop_tables`` deletes when the process ends."""
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    _tables[folder] = spark
    return folder


def materialise(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there and a lost executor costs nothing.

    arrow_rows: rows of an Arrow batch while it is written, for wide rows; what the session has otherwise. The tables lie in
    one folder an application, which ``drop_tables`` deletes when the process ends.
    """
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/table-{uuid.uuid4().hex}"
    with arrow_batches(spark, arrow_rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_pairs(members: DataFrame, bucket: list[str], weight: Column, block: int) -> tuple[DataFrame, list[str]]:
    """Deals the members (bucket, cid, ...) of each bucket to blocks of about ``block`` weight, and those to pairs of blocks.

    Adds block, lo and hi; bucket + lo + hi is a task's group, and of two members in different blocks, or in the same
    where lo = hi, each pair meets in exactly one group. Blocks are dealt by a hash of cid, so no task sees a whole
    bucket; only the buckets of several blocks are joined, and the stored table's size decides how.
    """
    sizes = members.groupBy(*bucket).agg(F.ceil(F.sum(weight) / block).cast("int").alias("blocks"))
    large = materialise(sizes.where("blocks > 1"))
    dealt = members.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.expr("int(pmod(xxhash64(cid), blocks))")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    return dealt, [*bucket, "lo", "hi"]


def by_group(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """The rows of each group of equal first columns (integers), which follow one another."""
    parts: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(columns)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if key is not None and key != tuple(keys[a]):
                yield pa.Table.from_batches(parts)
                parts = []
            key = tuple(keys[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b): smallest id reachable, by alternating large and small stars."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(e)
    while was[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        e = materialise(small)
        now = mark(e)
        if now == was:
            break
        was = now
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
