"""Binning, entropies and mutual information (nats) of the columns of a long matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STRATEGIES = ("equal_width", "equal_freq")


def bin_columns(m: DataFrame, bins: int | None = None, strategy: str = "equal_width") -> DataFrame:
    """Adds bin; by default floor(sqrt(rows)) bins. Equal frequency cuts at sorted values, so ties share a bin."""
    strategy = strategy.lower()
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    w = Window.partitionBy("col")
    n = F.count("*").over(w)
    k = F.lit(bins) if bins else F.floor(F.sqrt(n)).cast("int")
    if strategy == "equal_width":
        low, high = F.min("value").over(w), F.max("value").over(w)
        step = (high - low) / k
        at = F.when(step <= 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("value") - low, step)), k - 1))
        return m.withColumn("bin", at.cast("int"))
    ranked = m.withColumn("__r", F.row_number().over(w.orderBy("value")) - 1).withColumn("__n", n).withColumn("__k", k)
    # value number floor(i n / k) of the sorted column opens bin i
    cuts = ranked.withColumn("__i", F.explode(F.filter(F.array(F.floor(F.col("__r") * F.col("__k") / F.col("__n")), F.ceil(F.col("__r") * F.col("__k") / F.col("__n")), F.ceil((F.col("__r") + 0.5) * F.col("__k") / F.col("__n"))), lambda i: (i >= 1) & (i < F.col("__k")) & (F.floor(i * F.col("__n") / F.col("__k")) == F.col("__r")))))
    cuts = cuts.select("col", F.col("value").alias("cut"), F.col("__i").alias("i")).distinct().groupBy("col").agg(F.collect_list("cut").alias("cuts"))
    joined = m.join(cuts, "col", "left")
    return joined.withColumn("bin", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("value"))), F.lit(0)).cast("int")).drop("cuts")


def entropy(binned: DataFrame) -> DataFrame:
    """col, value."""
    n = binned.groupBy("col", "bin").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("col"))
    return n.withColumn("p", p).groupBy("col").agg((-F.sum(F.col("p") * F.ln("p"))).alias("value"))


def joint(binned: DataFrame) -> DataFrame:
    """Contingency counts of all pairs of columns with their marginals."""
    left = binned.select("row", F.col("col").alias("col_a"), F.col("bin").alias("x"))
    right = binned.select("row", F.col("col").alias("col_b"), F.col("bin").alias("y"))
    c = left.join(right, "row").where("col_a < col_b").groupBy("col_a", "col_b", "x", "y").agg(F.count("*").alias("nxy"))
    pair = Window.partitionBy("col_a", "col_b")
    return c.withColumn("n", F.sum("nxy").over(pair)).withColumn("nx", F.sum("nxy").over(Window.partitionBy("col_a", "col_b", "x"))).withColumn("ny", F.sum("nxy").over(Window.partitionBy("col_a", "col_b", "y")))


def mutual_information(binned: DataFrame, normalised: bool = False) -> DataFrame:
    """col_a, col_b, mi, joint_entropy; normalised: mi / joint entropy."""
    p = F.col("nxy") / F.col("n")
    out = joint(binned).groupBy("col_a", "col_b").agg(F.sum(p * F.ln(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi"), (-F.sum(p * F.ln(p))).alias("joint_entropy"))
    if normalised:
        out = out.withColumn("mi", F.when(F.col("joint_entropy") > 0, F.try_divide("mi", "joint_entropy")).otherwise(0.0))
    return out
