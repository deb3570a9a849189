"""Matrices as long tables (row, col, value): selection, algebra, scaling, reshaping. Absent entries are zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from helixframe.functions.columns import average_rank
from helixframe.plans.ids import dense_ids

EPS = 1e-9


def select(m: DataFrame, rows: Sequence[str] | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """A sub-matrix by names with their positions (row_pos, col_pos); unknown names are dropped."""
    spark, out = m.sparkSession, m
    for names, key in ((rows, "row"), (cols, "col")):
        if names is not None:
            kind = m.schema[key].dataType.simpleString()
            wanted = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{key} {kind}, {key}_pos int")
            out = out.join(F.broadcast(wanted), key)
    return out


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def from_dense(m: DataFrame) -> DataFrame:
    """Without stored zeros."""
    return m.where("value != 0")


def add(a: DataFrame, b: DataFrame, sign: float = 1.0, eps: float = EPS) -> DataFrame:
    """a + sign * b; where both have an entry, a sum of eps or less is dropped."""
    both = a.select("row", "col", "value", F.lit(1).alias("n")).union(b.select("row", "col", F.col("value") * sign, F.lit(1)))
    out = both.groupBy("row", "col").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    return out.where((F.col("n") == 1) | (F.abs("value") > eps)).drop("n")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1.0)


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("value", F.col("value") * factor)


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "other"), ["row", "col"]).select("row", "col", (F.col("value") * F.col("other")).alias("value"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """a . b as a join on the inner index with a partial sum before the shuffle."""
    left = a.select("row", F.col("col").alias("__k"), F.col("value").alias("__x"))
    right = b.select(F.col("row").alias("__k"), "col", F.col("value").alias("__y"))
    return left.join(right, "__k").groupBy("row", "col").agg(F.sum(F.col("__x") * F.col("__y")).alias("value"))


def matvec(a: DataFrame, v: DataFrame) -> DataFrame:
    """a . v for v(col, x): (row, x)."""
    return a.join(v, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("x"))


def gram(a: DataFrame) -> DataFrame:
    """Transposed a . a, upper triangle: (col_a, col_b, value)."""
    left, right = a.select("row", F.col("col").alias("col_a"), F.col("value").alias("__x")), a.select("row", F.col("col").alias("col_b"), F.col("value").alias("__y"))
    return left.join(right, "row").where("col_a <= col_b").groupBy("col_a", "col_b").agg(F.sum(F.col("__x") * F.col("__y")).alias("value"))


def frobenius(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def trace(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.when(F.col("row") == F.col("col"), F.col("value"))), F.lit(0.0)).alias("trace"))


def normalise_l1(a: DataFrame, by: str, least: float = 1e-15) -> DataFrame:
    """Rows or columns (by) divided by their sum; those of a sum of least or less become zero."""
    total = F.sum("value").over(Window.partitionBy(by))
    return a.withColumn("value", F.when(total > least, F.col("value") / total).otherwise(0.0))


def normalise_l2(a: DataFrame, by: str = "col") -> DataFrame:
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(by)))
    return a.withColumn("value", F.when(length > 1e-10, F.col("value") / length).otherwise(F.col("value")))


def scale_columns(a: DataFrame, sd: bool = True) -> DataFrame:
    """Centred columns of a dense table, divided by the sample sd unless that is near zero."""
    w = Window.partitionBy("col")
    mean, dev = F.avg("value").over(w), F.stddev_samp("value").over(w)
    centred = F.col("value") - mean
    return a.withColumn("value", F.when(F.lit(sd) & (dev >= 1e-10), centred / dev).otherwise(centred))


def rank_columns(a: DataFrame) -> DataFrame:
    return a.withColumn("value", average_rank("value", ["col"]))


def column_stats(a: DataFrame, rows: int | None = None) -> DataFrame:
    """Sum, mean and sample sd per column; rows: of a sparse table, zeros included."""
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    n = F.lit(float(rows)) if rows is not None else F.count("*").cast("double")
    variance = F.when(n > 1, F.greatest((q - s * s / n) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    sd = F.sqrt(variance) if rows is not None else F.stddev_samp("value")
    return a.groupBy("col").agg(s.alias("sum"), (s / n).alias("mean"), sd.alias("sd"))


def count_zeros(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """Zeros per row, per column and in all (row and col null), absent entries counted."""
    some = a.where("value != 0")
    grouped = some.groupingSets([["row"], ["col"], []], "row", "col").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    size = F.when(F.col("g") == 1, cols).when(F.col("g") == 2, rows).otherwise(rows * cols)
    return grouped.select("row", "col", (size - F.col("n")).cast("long").alias("zeros"))


def symmetric(upper: DataFrame) -> DataFrame:
    """The full matrix of an upper triangle."""
    return upper.union(transpose(upper.where("row != col")))


def upper_triangle(a: DataFrame, shift: int = 1) -> DataFrame:
    return a.where(F.col("col") - F.col("row") >= shift)


def diagonal(v: DataFrame) -> DataFrame:
    """v(i, x) as a diagonal matrix."""
    return v.select(F.col("i").alias("row"), F.col("i").alias("col"), F.col("x").alias("value"))


def drop_row(a: DataFrame, index: int) -> DataFrame:
    """Without a row; later rows move up."""
    return a.where(F.col("row") != index).withColumn("row", F.when(F.col("row") > index, F.col("row") - 1).otherwise(F.col("row")))


def bind_rows(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Stacked (matrix, number of rows) with running row ids."""
    out, at = None, 0
    for m, n in parts:
        m = m.withColumn("row", F.col("row") + at)
        out = m if out is None else out.unionByName(m)
        at += n
    return out


def bind_cols(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    return transpose(bind_rows([(transpose(m), n) for m, n in parts]))


def to_lists(a: DataFrame, cols: int) -> DataFrame:
    """(row, values): dense rows in column order, zeros filled; columns are 0..cols-1."""
    pairs = a.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    return pairs.select("row", F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0))).alias("values"))


def from_lists(lists: DataFrame) -> DataFrame:
    """(row, values) as a long matrix."""
    return lists.select("row", F.posexplode("values").alias("col", "value")).withColumn("col", F.col("col").cast("long"))


def prune(a: DataFrame, least: float) -> DataFrame:
    """Without entries of least or less; columns renormalised to sum 1."""
    return normalise_l1(a.where(F.abs("value") > least), "col")


def reindex(a: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Dense, order-preserving 0-based ids of a key, and their map."""
    ids = dense_ids(a.select(key).distinct(), [key], name)
    return a.join(ids, key).drop(key), ids


