"""Incremental ingestion: a stream of counts folded into running cell and gene summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.tables import COUNTS


def counts_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of (cell, gene, raw) as they arrive."""
    return spark.readStream.schema(COUNTS).parquet(path)


def running_summary(stream: DataFrame, key: str = "cell") -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("nnz"), F.sum("raw").alias("total"))


def start_summary(stream: DataFrame, checkpoint: str, name: str, key: str = "cell") -> StreamingQuery:
    """Keeps the running summary in an in-memory table; available-now trigger, state in the checkpoint."""
    return running_summary(stream, key).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_summary_table(stream: DataFrame, path: str, checkpoint: str, key: str = "cell") -> StreamingQuery:
    """Keeps the running summary in parquet: each batch writes the keys it changed to its own folder, batch=n.

    A batch that runs again replaces its folder, so the table is exact; ``latest_summary`` reads the newest row of a key.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return running_summary(stream, key).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_summary(spark: SparkSession, path: str, key: str = "cell") -> DataFrame:
    """Per key the row of the last batch that changed it."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct("nnz", "total"), "batch").alias("x")).select(key, "x.*")


def start_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends arriving counts to a parquet table exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
