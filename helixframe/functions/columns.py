"""Column expressions and windows shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def average_rank(value: str, by: Sequence[str] = (), descending: bool = False) -> Column:
    """1-based ranks, ties get their mean. Without ``by`` the window is one partition: for gene-sized inputs."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    first = F.rank().over(Window.partitionBy(*by).orderBy(order))
    return first + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def with_fdr(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within ``by``, capped at 1."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last()))
    n = F.count(p).over(Window.partitionBy(*by))
    down = Window.partitionBy(*by).orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__i", i).withColumn("__q", F.col(p) * n / F.col("__i"))
    return out.withColumn(name, F.least(F.min("__q").over(down), F.lit(1.0))).drop("__i", "__q")


def cumulative(value: str, order: Sequence[str], by: Sequence[str] = ()) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def safe_divide(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(F.try_divide(a, b))


def clip(x: Column, low: float | None, high: float | None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def inv_logit(q: Column) -> Column:
    return F.exp(q) / (1 + F.exp(q))


RBF = ("gaussian", "bump", "inverse_quadratic")


def rbf(r: Column, epsilon: Column, kind: str = "gaussian") -> Column:
    """Radial basis kernels of a distance."""
    kind = kind.lower()
    x = epsilon * r
    if kind == "gaussian":
        return F.exp(-(x * x))
    if kind == "bump":
        return F.when(x < 1, F.exp(F.lit(1.0) - 1 / F.greatest(1 - x * x, F.lit(1e-300)))).otherwise(0.0)
    if kind == "inverse_quadratic":
        return 1 / (1 + x * x)
    raise ValueError(f"unknown kernel {kind!r}")


def tricube(u: Column) -> Column:
    return F.when(F.abs(u) < 1, F.pow(1 - F.pow(F.abs(u), 3), 3)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1; a near-zero one stays as it is."""
    return F.when(norm(a) > 1e-10, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; two empty sets give null."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def log_norm(raw: Column, library: Column, target: float) -> Column:
    return F.log1p(raw / library * F.lit(float(target)))


def raw_from_norm(norm_: Column, library: Column, target: float) -> Column:
    """The count that log_norm came from: rounded, within 0..65535."""
    return F.when((norm_ <= 0) | (library <= 0), F.lit(0)).otherwise(F.round(clip(F.expm1(norm_) * library / F.lit(float(target)), 0.0, 65535.0)).cast("int"))


def array_min_max(a: Column) -> Column:
    return F.struct(F.array_max(a).alias("max"), F.array_min(a).alias("min"))
