"""The count store: one parquet table sorted by cell, one by gene, and summaries, so either kind of lookup prunes row groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.operators import cells as C
from helixframe.plans.ids import dense_ids

VERSION = 3


def write(counts: DataFrame, path: str, target: float = 1e4) -> None:
    """counts(cell, gene, raw) normalised and written both ways; earlier contents are replaced."""
    norm = C.normalise(counts, target)
    norm.repartitionByRange("cell").sortWithinPartitions("cell", "gene").write.mode("overwrite").parquet(f"{path}/cells")
    stored = counts.sparkSession.read.parquet(f"{path}/cells")
    stored.repartitionByRange("gene").sortWithinPartitions("gene", "cell").write.mode("overwrite").parquet(f"{path}/genes")
    C.cell_summary(stored).write.mode("overwrite").parquet(f"{path}/cell_summary")
    C.gene_summary(stored).write.mode("overwrite").parquet(f"{path}/gene_summary")
    head = stored.agg(F.countDistinct("cell").alias("cells"), F.countDistinct("gene").alias("genes"), F.count("*").alias("nnz")).withColumn("version", F.lit(VERSION)).withColumn("target", F.lit(float(target)))
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/header")


def read(spark: SparkSession, path: str, by: str = "cells") -> DataFrame:
    if by not in ("cells", "genes"):
        raise ValueError("by is cells or genes")
    return spark.read.parquet(f"{path}/{by}")


def read_ids(spark: SparkSession, path: str, ids: Sequence[int], by: str = "cells") -> DataFrame:
    """Rows of some cells or genes with the position (pos) each was asked at."""
    key = by[:-1]
    wanted = spark.createDataFrame([(int(v), i) for i, v in enumerate(ids)], f"{key} long, pos int")
    own = sorted({int(v) for v in ids})
    # row groups are pruned by the ids, or by their range where a list would be too long to push down
    some = F.col(key).isin(own) if len(own) <= 1000 else F.col(key).between(own[0], own[-1])
    return read(spark, path, by).where(some).join(F.broadcast(wanted) if len(ids) <= 100_000 else wanted, key)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Cells first..last-1."""
    return read(spark, path).where(F.col("cell").between(first, last - 1))


def library_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cell_summary").select("cell", "lib_size")


def gene_nnz(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/gene_summary").select("gene", "nnz")


def write_version_2(counts: DataFrame, path: str, target: float = 1e4) -> None:
    """The store as version 2 had it: 16-bit counts (larger ones are cut), by cells only."""
    short = counts.withColumn("raw", F.least("raw", F.lit(32767)).cast("smallint"))
    C.normalise(short, target).repartitionByRange("cell").sortWithinPartitions("cell", "gene").write.mode("overwrite").parquet(f"{path}/cells")
    head = counts.agg(F.countDistinct("cell").alias("cells"), F.countDistinct("gene").alias("genes"), F.count("*").alias("nnz"))
    head.select("*", F.lit(2).alias("version"), F.lit(float(target)).alias("target")).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def migrate(spark: SparkSession, old: str, new: str) -> None:
    """A version 2 store (16-bit counts) as version 3; the old one stays. Another version is refused."""
    version = header(spark, old).first().version
    if version != 2:
        raise ValueError(f"expected version 2, found {version}")
    h = header(spark, old).first()
    write(read(spark, old).select("cell", "gene", F.col("raw").cast("int").alias("raw")), new, h.target)


def combine(parts: Sequence[DataFrame], min_cells: int = 10, min_genes: int = 100, min_library: int = 250) -> DataFrame:
    """Several count tables as one: genes by their cells over all parts, cells within their part, ids appended in order.

    Adds part and old_cell.
    """
    every = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), F.col("cell").alias("old_cell"), "gene", "raw")
        every = p if every is None else every.union(p)
    genes = every.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).select("gene")
    kept = every.join(genes, "gene", "left_semi")
    good = kept.groupBy("part", "old_cell").agg(F.count("*").alias("nnz"), F.sum("raw").alias("lib")).where((F.col("nnz") >= min_genes) & (F.col("lib") >= min_library))
    ids = dense_ids(good.select("part", "old_cell"), ["part", "old_cell"], "cell")
    return kept.join(ids, ["part", "old_cell"]).select("cell", "gene", "raw", "part", "old_cell")
