"""The logical tables, and how the star-schema parquet files stand in for them.

counts(cell, gene, raw): customers are cells, parts are genes, ordered quantity is the count. Absent entries are zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

COUNTS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("gene", T.LongType()), T.StructField("raw", T.IntegerType())])
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("w", T.DoubleType())])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("int").alias("raw"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, batch (region), label (segment)."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("cell"), F.col("r_name").alias("batch"), F.col("c_mktsegment").alias("label"))


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id (brand), gene."""
    return load(spark, sf_dir, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("gene"))


def gene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, stat: the share of returned quantity, centred: a signed statistic per part."""
    lines = load(spark, sf_dir, "lineitem")
    share = lines.groupBy(F.col("l_partkey").alias("gene")).agg((F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity")).alias("s"))
    mean = share.agg(F.avg("s").alias("m"))
    return share.crossJoin(mean).select("gene", F.round(F.col("s") - F.col("m"), 9).alias("stat"))


def matrix(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """row (part), col, value: six numeric columns of parts and their sales.

    in_order: sums of doubles are added up in the order of the file's rows, for what the last digit of a value decides.
    """
    p, lines = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    if in_order:
        lines = lines.select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
        so_far = Window.partitionBy("l_partkey").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = {"quantity": F.sum("l_quantity"), "revenue": F.sum("l_extendedprice"), "discount": F.sum("l_discount"), "lines": F.count("*")}
        last = lines.select("l_partkey", "at", *[x.over(so_far).alias(c) for c, x in sums.items()]).groupBy("l_partkey").agg(F.max_by(F.struct(*sums), "at").alias("x"))
        sold = last.select("l_partkey", "x.quantity", "x.revenue", (F.col("x.discount") / F.col("x.lines")).alias("discount"), F.col("x.lines").cast("double").alias("lines"))
    else:
        sold = lines.groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("revenue"), F.avg("l_discount").alias("discount"), F.count("*").cast("double").alias("lines"))
    wide = p.join(sold, p.p_partkey == sold.l_partkey).select(F.col("p_partkey").alias("row"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), "quantity", "revenue", "discount", "lines")
    return melt(wide, "row")


def melt(wide: DataFrame, row: str) -> DataFrame:
    names = [c for c in wide.columns if c != row]
    return wide.unpivot([row], names, "col", "value")


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("label"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (nation of the customer), dst (nation of the supplier), w (lines between them)."""
    o, li, c, s = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("w"))


def ontology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child, w: world, regions, nations, market segments of nations."""
    n, r, c = (load(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    top = r.select(F.lit("world").alias("parent"), F.col("r_name").alias("child"))
    mid = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    low = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("parent"), F.concat_ws("/", "n_name", "c_mktsegment").alias("child")).distinct()
    return top.union(mid).union(low).withColumn("w", F.lit(0.8))


def term_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, gene: customers of each leaf, and so of all its ancestors."""
    n, r, c = (load(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    terms = F.array(F.lit("world"), "r_name", "n_name", F.concat_ws("/", "n_name", "c_mktsegment"))
    return j.select(F.explode(terms).alias("term"), F.col("c_custkey").alias("gene"))
