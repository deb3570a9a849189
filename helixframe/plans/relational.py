"""Registered queries that SQL can express, each with its oracle for the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixframe import tables as T
from helixframe.functions import columns as K
from helixframe.functions.special import hypergeom_col
from helixframe.operators import cells as C
from helixframe.operators import decomposition as D
from helixframe.operators import enrichment as E
from helixframe.operators import graph as G
from helixframe.operators import hotspot as H
from helixframe.operators import info as I
from helixframe.operators import matrix as M
from helixframe.operators import neighbours as N
from helixframe.operators import ontology as O
from helixframe.operators import similarity as S
from helixframe.operators import stats as Z
from helixframe.plans.checkpoint import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions of the oracles.
CTE = {
    "counts": "SELECT o_custkey AS cell, l_partkey AS gene, CAST(sum(l_quantity) AS INTEGER) AS raw FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "norm": "SELECT cell, gene, raw, ln(1 + raw / CAST(sum(raw) OVER (PARTITION BY cell) AS DOUBLE) * 10000.0) AS norm FROM counts",
    "cells": "SELECT c_custkey AS cell, r_name AS batch, c_mktsegment AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "sets": "SELECT p_brand AS set_id, p_partkey AS gene FROM part",
    "kinds": "SELECT set_id, gene, true AS x FROM sets UNION ALL SELECT set_id, gene + 1, false FROM sets",
    "share0": "SELECT l_partkey AS gene, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS s FROM lineitem GROUP BY 1",
    "stats": "SELECT gene, round(s - (SELECT avg(s) FROM share0), 9) AS stat FROM share0",
    "ranked": "SELECT gene, stat, row_number() OVER (ORDER BY stat DESC, gene) AS pos FROM stats",
    "sold": "SELECT l_partkey, sum(l_quantity) AS quantity, sum(l_extendedprice) AS revenue, avg(l_discount) AS discount, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY 1",
    "wide": "SELECT p_partkey AS row, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, quantity, revenue, discount, lines FROM part JOIN sold ON p_partkey = l_partkey",
    "m": "SELECT row, 'size' AS col, size AS value FROM wide UNION ALL SELECT row, 'price', price FROM wide UNION ALL SELECT row, 'quantity', quantity FROM wide UNION ALL SELECT row, 'revenue', revenue FROM wide UNION ALL SELECT row, 'discount', discount FROM wide UNION ALL SELECT row, 'lines', lines FROM wide",
    "mr": "SELECT row, col, rank() OVER (PARTITION BY col ORDER BY value) + (count(*) OVER (PARTITION BY col, value) - 1) / 2.0 AS value FROM m",
    "mp": "SELECT x.row, x.col AS col_a, y.col AS col_b, x.value AS a, y.value AS b FROM m x JOIN m y ON x.row = y.row AND x.col < y.col",
    "edges": "SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "a": "SELECT src AS row, dst AS col, w AS value FROM edges WHERE w > 20",
    "b": "SELECT dst AS row, src AS col, w / 2 AS value FROM edges WHERE src <> dst",
    "und": "SELECT src, dst, w FROM (SELECT src, dst, w FROM edges WHERE src < dst UNION ALL SELECT dst, src, w FROM edges WHERE src < dst) z",
    "aff": "SELECT src AS row, dst AS col, w / (SELECT max(w) FROM und) AS value FROM und",
    "t": "SELECT src AS row, dst AS col, w AS value FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM und) q WHERE r <= 4",
    "deg": "SELECT src AS id, sum(w) AS d FROM und GROUP BY 1",
    "points": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS INTEGER) AS batch FROM embeddings",
    "dists": "SELECT x.id, y.id AS nbr, 1 - list_dot_product(x.vec, y.vec) / (sqrt(list_dot_product(x.vec, x.vec)) * sqrt(list_dot_product(y.vec, y.vec))) AS dist FROM points x JOIN points y ON x.id <> y.id",
    "nn": "SELECT id, nbr, dist, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), nbr) AS r FROM dists) z WHERE r <= 10",
    "onto": "SELECT 'world' AS parent, r_name AS child, 0.8 AS w FROM region UNION ALL SELECT r_name, n_name, 0.8 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT n_name, n_name || '/' || c_mktsegment, 0.8 FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "tg": "SELECT unnest(['world', r_name, n_name, n_name || '/' || c_mktsegment]) AS term, c_custkey AS gene FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "members": "SELECT 0 AS run, p_partkey AS feature, p_brand AS cluster FROM part UNION ALL SELECT 1, p_partkey, p_type FROM part UNION ALL SELECT 2, p_partkey, CAST(p_size // 10 AS VARCHAR) FROM part",
    "items": "SELECT DISTINCT p_brand AS set_id, cell AS item FROM counts JOIN part ON gene = p_partkey WHERE raw >= 60",
    "types": "SELECT DISTINCT p_type AS set_id, cell AS item FROM counts JOIN part ON gene = p_partkey WHERE raw >= 60",
    "closure": "SELECT child AS term, child AS ancestor, 1.0 AS s FROM onto",
}
NEEDS = {"norm": "counts", "kinds": "sets", "stats": "share0", "ranked": "stats", "wide": "sold", "m": "wide", "mr": "m", "mp": "m", "a": "edges", "b": "edges", "und": "edges", "deg": "und", "aff": "und", "t": "und", "dists": "points", "nn": "dists", "items": "counts", "types": "counts"}


def sql(body: str, *names: str) -> str:
    """The body after the expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in NEEDS:
            add(NEEDS[name])
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " if order else "") + body


def register(oracle: str | None = None, *needs: str):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:  # others are put in directly
            ORACLE_SQL[f.__name__] = sql(oracle, *needs)
        return f

    return put


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return C.normalise(T.counts(spark, d))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return T.cells(spark, d).select("cell", F.col("batch").alias("grp"))


# ---- cells ---------------------------------------------------------------------------------------------------------


@register("SELECT batch AS grp, gene, round(sum(norm) / any_value(n), 6) AS value FROM norm JOIN cells USING (cell) JOIN (SELECT batch, count(*) AS n FROM cells GROUP BY 1) z USING (batch) GROUP BY 1, 2", "norm", "cells")
def pseudobulk_by_batch(spark, d):
    return r6(C.pseudo_bulk(_norm(spark, d), _groups(spark, d), "norm"), "value")


@register("SELECT batch AS grp, gene, CAST(sum(raw) AS DOUBLE) AS value FROM counts JOIN cells USING (cell) GROUP BY 1, 2", "counts", "cells")
def pseudobulk_raw(spark, d):
    return C.pseudo_bulk(_norm(spark, d), _groups(spark, d), "raw")


@register("SELECT cell, CAST(count(*) AS BIGINT) AS nnz, CAST(sum(raw) AS BIGINT) AS lib_size FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING count(*) >= 20) GROUP BY 1 HAVING count(*) >= 20 AND sum(raw) >= 500", "counts")
def quality_filter(spark, d):
    return C.cell_summary(C.quality_filter(T.counts(spark, d), 20, 20, 500))


@register("SELECT cell, gene, raw, round(norm, 6) AS norm FROM norm", "norm")
def log_normalise(spark, d):
    return r6(_norm(spark, d), "norm")


@register("SELECT cell, CAST(count(*) AS BIGINT) AS nnz, CAST(sum(raw) AS BIGINT) AS lib_size FROM counts GROUP BY 1", "counts")
def cell_summary(spark, d):
    return C.cell_summary(T.counts(spark, d))


@register("SELECT gene, count(*) AS nnz, round(sum(norm), 6) AS sum_norm FROM norm GROUP BY 1", "norm")
def gene_summary(spark, d):
    return r6(C.gene_summary(_norm(spark, d)), "sum_norm")


@register("SELECT cell, top, round(sum(CASE WHEN r <= top THEN raw ELSE 0 END) / sum(raw), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY raw DESC, gene) AS r FROM counts) z, (SELECT unnest([5, 20]) AS top) t GROUP BY 1, 2", "counts")
def top_gene_share(spark, d):
    return r6(C.top_gene_share(T.counts(spark, d), (5, 20)), "share")


@register("SELECT cell, set_id, round(sum(raw) / any_value(lib), 6) AS share FROM counts JOIN sets USING (gene) JOIN (SELECT cell, sum(raw) AS lib FROM counts GROUP BY 1) z USING (cell) GROUP BY 1, 2", "counts", "sets")
def gene_set_share(spark, d):
    return r6(C.gene_set_share(T.counts(spark, d), T.gene_sets(spark, d)), "share")


@register("SELECT gene, label AS grp, round(sum(norm) / any_value(n), 6) AS mean, round(count(*) / any_value(n), 6) AS share FROM norm JOIN cells USING (cell) JOIN (SELECT label, count(*) AS n FROM cells GROUP BY 1) z USING (label) GROUP BY 1, 2", "norm", "cells")
def grouped_gene_stats(spark, d):
    return r6(C.grouped_gene_stats(_norm(spark, d), T.cells(spark, d).select("cell", F.col("label").alias("grp"))), "mean", "share")


@register("SELECT cell, raw, round(greatest(least((norm - avg(norm) OVER ()) / stddev_pop(norm) OVER (), 3.0), -3.0), 6) AS norm FROM (SELECT c.cell, coalesce(n.raw, 0) AS raw, coalesce(n.norm, 0.0) AS norm FROM cells c LEFT JOIN (SELECT * FROM norm WHERE gene = 7) n USING (cell)) z", "norm", "cells")
def gene_vector(spark, d):
    return r6(C.gene_vector(_norm(spark, d), T.cells(spark, d), 7, True, 3.0), "norm")


@register("SELECT dense_rank() OVER (ORDER BY cell) - 1 AS cell, dense_rank() OVER (ORDER BY gene) - 1 AS gene, raw FROM (SELECT * FROM counts WHERE raw >= 60) z", "counts")
def dense_reindex(spark, d):
    return C.reindexed(T.counts(spark, d).where("raw >= 60"))[0]


@register("SELECT metacell, gene, CAST(raw AS BIGINT) AS raw, round(ln(1 + raw / sum(raw) OVER (PARTITION BY metacell) * 10000.0), 6) AS norm FROM (SELECT cell % 50 AS metacell, gene, CAST(sum(raw) AS DOUBLE) AS raw FROM counts GROUP BY 1, 2) z", "counts")
def metacell_counts(spark, d):
    members = T.cells(spark, d).select((F.col("cell") % 50).alias("metacell"), "cell")
    return r6(C.aggregate_metacells(T.counts(spark, d), members), "norm")


@register("SELECT gene, round(s / n, 6) AS mean, round(q / n - (s / n) * (s / n), 6) AS var FROM (SELECT gene, sum(raw) AS s, sum(CAST(raw AS DOUBLE) * raw) AS q FROM counts GROUP BY 1) z, (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer) c", "counts")
def gene_mean_variance(spark, d):
    return r6(C.mean_variance(T.counts(spark, d), T.cells(spark, d).count()), "mean", "var")


@register("SELECT cell, gene, rank() OVER (PARTITION BY cell ORDER BY norm) + (count(*) OVER (PARTITION BY cell, norm) - 1) / 2.0 + n - count(*) OVER (PARTITION BY cell) AS rank, (1 + n - count(*) OVER (PARTITION BY cell)) / 2.0 AS zero_rank FROM norm, (SELECT count(*) AS n FROM part) p", "norm")
def cell_ranks(spark, d):
    n = T.load(spark, d, "part").count()
    return C.ranks_within(_norm(spark, d), "cell", n).select("cell", "gene", "rank", "zero_rank")


def _two_groups(spark, d):
    c = T.cells(spark, d)
    return c.where("label = 'BUILDING'"), c.where("label = 'MACHINERY'")


@register(
    """SELECT gene, round(k1 / n1, 6) AS share_1, round(k2 / n2, 6) AS share_2, round(s1 / n1 - s2 / n2, 6) AS lfc,
    round((r1 + (n1 - k1) * (1 + n0) / 2.0 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM (
    SELECT gene, any_value(n1) AS n1, any_value(n2) AS n2, any_value(n0) AS n0, sum(g) AS k1, sum(1 - g) AS k2, sum(g * norm) AS s1, sum((1 - g) * norm) AS s2, sum(g * rk) AS r1 FROM (
    SELECT gene, g, norm, CAST(n1 AS DOUBLE) AS n1, CAST(n2 AS DOUBLE) AS n2, n1 + n2 - count(*) OVER (PARTITION BY gene) AS n0,
    rank() OVER (PARTITION BY gene ORDER BY norm) + (count(*) OVER (PARTITION BY gene, norm) - 1) / 2.0 + n1 + n2 - count(*) OVER (PARTITION BY gene) AS rk
    FROM (SELECT n.gene, n.norm, CASE WHEN label = 'BUILDING' THEN 1 ELSE 0 END AS g FROM norm n JOIN cells USING (cell) WHERE label IN ('BUILDING', 'MACHINERY')) x,
    (SELECT count(*) FILTER (WHERE label = 'BUILDING') AS n1, count(*) FILTER (WHERE label = 'MACHINERY') AS n2 FROM cells) c) y GROUP BY 1) z
    WHERE k1 / n1 >= 0.02 OR k2 / n2 >= 0.02""",
    "norm", "cells",
)
def dge_mann_whitney(spark, d):
    return r6(C.dge(_norm(spark, d), *_two_groups(spark, d), 0.02).drop("p", "fdr"), "share_1", "share_2", "lfc", "z")


@register()
def dge_pvalues(spark, d):
    return r6(C.dge(_norm(spark, d), *_two_groups(spark, d), 0.02), "share_1", "share_2", "lfc", "z", "p", "fdr")


_AUC = """SELECT cell, set_id, {score} AS auc FROM (
    SELECT g.cell, g.set_id, g.m, g.zero_rank, coalesce(sum(r.rk), 0) AS r, count(r.rk) AS k, n FROM
    (SELECT cell, set_id, m, zero_rank, n FROM (SELECT cell, (1 + n - count(*)) / 2.0 AS zero_rank, any_value(n) AS n FROM norm, (SELECT count(*) AS n FROM part) p GROUP BY cell, n) c, (SELECT set_id, count(*) AS m FROM sets GROUP BY 1) s) g
    LEFT JOIN (SELECT cell, set_id, rk FROM (SELECT cell, gene, rank() OVER (PARTITION BY cell ORDER BY norm) + (count(*) OVER (PARTITION BY cell, norm) - 1) / 2.0 + n - count(*) OVER (PARTITION BY cell) AS rk FROM norm, (SELECT count(*) AS n FROM part) p) x JOIN sets USING (gene)) r USING (cell, set_id)
    GROUP BY g.cell, g.set_id, g.m, g.zero_rank, n) z"""


@register(_AUC.format(score="round((r + (m - k) * zero_rank - m * (m + 1) / 2.0) / (m * (n - m)), 6)"), "norm", "sets")
def aucell_wilcox(spark, d):
    return r6(C.set_activity(_norm(spark, d), T.gene_sets(spark, d), T.load(spark, d, "part").count(), "wilcox"), "auc")


@register(_AUC.format(score="round((r + (m - k) * zero_rank - (m + 1) / 2.0 * n) / (m * (n - m / 2.0)), 6)"), "norm", "sets")
def aucell_auroc(spark, d):
    return r6(C.set_activity(_norm(spark, d), T.gene_sets(spark, d), T.load(spark, d, "part").count(), "auroc"), "auc")


@register("SELECT gene, CAST(least(floor((row_number() OVER (ORDER BY mean, gene) - 1) / ceil(count(*) OVER () / 24.0)), 23) AS INTEGER) AS bin FROM (SELECT gene, round(sum(norm), 9) AS mean FROM norm GROUP BY 1) z", "norm")
def expression_bins(spark, d):
    means = _norm(spark, d).groupBy("gene").agg(F.round(F.sum("norm"), 9).alias("mean"))
    return C.expression_bins(means)


@register("SELECT cell, set_id, round(sum(CASE WHEN x THEN norm ELSE 0 END) / any_value(a) - sum(CASE WHEN x THEN 0 ELSE norm END) / any_value(b), 6) AS score FROM norm JOIN kinds USING (gene) JOIN (SELECT set_id, greatest(count(*) FILTER (WHERE x), 1) AS a, greatest(count(*) FILTER (WHERE NOT x), 1) AS b FROM kinds GROUP BY 1) z USING (set_id) GROUP BY 1, 2", "norm", "kinds")
def module_scores(spark, d):
    sets = T.gene_sets(spark, d)
    return r6(C.module_scores(_norm(spark, d), sets, sets.select("set_id", (F.col("gene") + 1).alias("gene"))), "score")


@register()
def module_scores_sampled(spark, d):
    norm, sets = cut(_norm(spark, d)), T.gene_sets(spark, d)
    bins = C.expression_bins(norm.groupBy("gene").agg(F.round(F.sum("norm"), 9).alias("mean")))
    return C.module_scores(norm, sets, C.control_genes(sets, bins, 20))


@register("SELECT c.cell, s.set_id, round(CASE WHEN sd > 0 THEN (coalesce(v, 0) / m - mu) / sd ELSE 0 END, 6) AS score FROM (SELECT cell, sum(norm) / n AS mu, sqrt(greatest(sum(norm * norm) / n - (sum(norm) / n) * (sum(norm) / n), 0)) AS sd FROM norm, (SELECT CAST(count(*) AS DOUBLE) AS n FROM part) p GROUP BY cell, n) c CROSS JOIN (SELECT set_id, count(*) AS m FROM sets GROUP BY 1) s LEFT JOIN (SELECT cell, set_id, sum(norm * CASE WHEN gene % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM norm JOIN sets USING (gene) GROUP BY 1, 2) x ON x.cell = c.cell AND x.set_id = s.set_id", "norm", "sets")
def signature_scores(spark, d):
    signs = T.gene_sets(spark, d).withColumn("sign", F.when(F.col("gene") % 2 == 0, 1.0).otherwise(-1.0))
    return r6(C.signature_scores(_norm(spark, d), signs, T.load(spark, d, "part").count()), "score")


@register("SELECT gene_a, gene_b, round((coalesce(xy, 0) - sa * sb / n) / sqrt((qa - sa * sa / n) * (qb - sb * sb / n)), 6) AS value FROM (SELECT p_partkey AS gene_a, p_partkey + 1 AS gene_b FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part)) p LEFT JOIN (SELECT x.gene AS gene_a, y.gene AS gene_b, sum(x.norm * y.norm) AS xy FROM norm x JOIN norm y ON x.cell = y.cell AND y.gene = x.gene + 1 GROUP BY 1, 2) j USING (gene_a, gene_b) JOIN (SELECT gene AS gene_a, sum(norm) AS sa, sum(norm * norm) AS qa FROM norm GROUP BY 1) a USING (gene_a) JOIN (SELECT gene AS gene_b, sum(norm) AS sb, sum(norm * norm) AS qb FROM norm GROUP BY 1) b USING (gene_b), (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer) c", "norm")
def gene_correlations(spark, d):
    p = T.load(spark, d, "part")
    pairs = p.select(F.col("p_partkey").alias("gene_a"), (F.col("p_partkey") + 1).alias("gene_b")).join(p.select(F.col("p_partkey").alias("gene_b")), "gene_b", "left_semi")
    return r6(C.gene_correlations(_norm(spark, d), pairs, T.cells(spark, d).count()), "value")


@register("SELECT gene FROM counts, (SELECT count(*) AS n FROM customer) c GROUP BY gene, n HAVING sum(raw) >= 800 AND count(*) / n >= 0.02", "counts")
def expressed_genes(spark, d):
    return C.expressed_genes(T.counts(spark, d), T.cells(spark, d).count(), 800, 0.02)


@register("SELECT cell, gene, raw AS rebuilt FROM counts", "counts")
def raw_from_normalised(spark, d):
    norm = _norm(spark, d).withColumn("lib", F.sum("raw").over(Window.partitionBy("cell")))
    return norm.select("cell", "gene", K.raw_from_norm(F.col("norm"), F.col("lib"), 1e4).alias("rebuilt"))


# ---- matrices ------------------------------------------------------------------------------------------------------


def _a(spark, d):
    return T.edges(spark, d).where("w > 20").select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("value"))


def _b(spark, d):
    return T.edges(spark, d).where("src <> dst").select(F.col("dst").alias("row"), F.col("src").alias("col"), (F.col("w") / 2).alias("value"))


@register("SELECT row, col, sum(value) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) z GROUP BY 1, 2 HAVING count(*) = 1 OR abs(sum(value)) > 1e-9", "a", "b")
def sparse_add(spark, d):
    return M.add(_a(spark, d), _b(spark, d))


@register("SELECT row, col, sum(value) AS value FROM (SELECT * FROM a UNION ALL SELECT row, col, -value FROM b) z GROUP BY 1, 2 HAVING count(*) = 1 OR abs(sum(value)) > 1e-9", "a", "b")
def sparse_subtract(spark, d):
    return M.subtract(_a(spark, d), _b(spark, d))


@register("SELECT row, col, a.value * b.value AS value FROM a JOIN b USING (row, col)", "a", "b")
def sparse_hadamard(spark, d):
    return M.hadamard(_a(spark, d), _b(spark, d))


@register("SELECT a.row, b.col, sum(a.value * b.value) AS value FROM a JOIN b ON a.col = b.row GROUP BY 1, 2", "a", "b")
def sparse_matmul(spark, d):
    return M.matmul(_a(spark, d), _b(spark, d))


@register("SELECT row, sum(value * (col + 1)) AS x FROM a GROUP BY 1", "a")
def sparse_matvec(spark, d):
    v = T.load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("col"), (F.col("n_nationkey") + 1.0).alias("x"))
    return M.matvec(_a(spark, d), v)


@register("SELECT x.col AS col_a, y.col AS col_b, sum(x.value * y.value) AS value FROM a x JOIN a y ON x.row = y.row AND x.col <= y.col GROUP BY 1, 2", "a")
def sparse_gram(spark, d):
    return M.gram(_a(spark, d))


@register("SELECT round(sqrt(sum(value * value)), 6) AS norm FROM a", "a")
def frobenius_norm(spark, d):
    return r6(M.frobenius(_a(spark, d)), "norm")


@register("SELECT coalesce(sum(value) FILTER (WHERE row = col), 0) AS trace FROM a", "a")
def matrix_trace(spark, d):
    return M.trace(_a(spark, d))


@register("SELECT row, col, round(value / sum(value) OVER (PARTITION BY row), 9) AS value FROM a", "a")
def rows_l1(spark, d):
    return M.normalise_l1(_a(spark, d), "row").withColumn("value", F.round("value", 9))


@register("SELECT row, col, round(value / sqrt(sum(value * value) OVER (PARTITION BY col)), 9) AS value FROM a", "a")
def columns_l2(spark, d):
    return M.normalise_l2(_a(spark, d)).withColumn("value", F.round("value", 9))


@register("SELECT row, col, round((value - avg(value) OVER (PARTITION BY col)) / stddev_samp(value) OVER (PARTITION BY col), 6) AS value FROM m", "m")
def scaled_columns(spark, d):
    return r6(M.scale_columns(T.matrix(spark, d)), "value")


@register("SELECT row, col, value FROM mr", "mr")
def ranked_columns(spark, d):
    return M.rank_columns(T.matrix(spark, d, True))


@register("SELECT col, sum(value) AS sum, round(sum(value) / 25, 6) AS mean, round(sqrt(greatest((sum(value * value) - sum(value) * sum(value) / 25) / 24, 0)), 6) AS sd FROM a GROUP BY 1", "a")
def column_statistics(spark, d):
    return r6(M.column_stats(_a(spark, d), 25), "mean", "sd")


@register("SELECT row, NULL AS col, CAST(25 - count(*) AS BIGINT) AS zeros FROM a GROUP BY 1 UNION ALL SELECT NULL, col, 25 - count(*) FROM a GROUP BY col UNION ALL SELECT NULL, NULL, 625 - count(*) FROM a", "a")
def zero_counts(spark, d):
    return M.count_zeros(_a(spark, d), 25, 25)


@register("SELECT row, col, value FROM a WHERE col > row UNION ALL SELECT col, row, value FROM a WHERE col > row", "a")
def symmetric_from_upper(spark, d):
    return M.symmetric(M.upper_triangle(_a(spark, d)))


@register("SELECT row, col, value, list_position([3, 1, 99], row) - 1 AS row_pos, list_position([0, 5, 7], col) - 1 AS col_pos FROM a WHERE row IN (3, 1) AND col IN (0, 5, 7)", "a")
def sub_matrix(spark, d):
    return M.select(_a(spark, d), [3, 1, 99], [0, 5, 7])


# ---- similarity and information --------------------------------------------------------------------------------------


@register("SELECT x.col AS col_a, y.col AS col_b, round(covar_samp(x.value, y.value), 2) AS value FROM m x JOIN m y ON x.row = y.row AND x.col <= y.col GROUP BY 1, 2", "m")
def column_covariance(spark, d):
    return S.covariance(T.matrix(spark, d)).withColumn("value", F.round("value", 2))


@register("SELECT col_a, col_b, round(corr(a, b), 6) AS value FROM mp GROUP BY 1, 2", "mp")
def column_pearson(spark, d):
    return r6(S.correlation(T.matrix(spark, d)), "value")


@register("SELECT x.col AS col_a, y.col AS col_b, round(corr(x.value, y.value), 6) AS value FROM mr x JOIN mr y ON x.row = y.row AND x.col < y.col GROUP BY 1, 2", "mr")
def column_spearman(spark, d):
    return r6(S.correlation(T.matrix(spark, d), True), "value")


@register("SELECT x.col AS col_a, y.col AS col_b, round(corr(x.value, y.value), 6) AS value FROM (SELECT * FROM m WHERE col IN ('size', 'price')) x JOIN (SELECT * FROM m WHERE col IN ('revenue', 'lines')) y ON x.row = y.row GROUP BY 1, 2", "m")
def cross_correlation(spark, d):
    m = T.matrix(spark, d)
    return r6(S.cross_correlation(m.where("col IN ('size', 'price')"), m.where("col IN ('revenue', 'lines')")), "value")


@register("SELECT col_a, col_b, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS value FROM mp GROUP BY 1, 2", "mp")
def column_cosine(spark, d):
    return r6(S.cosine(T.matrix(spark, d)), "value")


@register("SELECT col_a, col_b, round(sum(abs(a - b)), 3) AS value FROM mp GROUP BY 1, 2", "mp")
def column_manhattan(spark, d):
    return S.distance(T.matrix(spark, d), "manhattan").withColumn("value", F.round("value", 3))


@register("SELECT col_a, col_b, round(sqrt(sum((a - b) * (a - b))), 2) AS value FROM mp GROUP BY 1, 2", "mp")
def column_euclidean(spark, d):
    return S.distance(T.matrix(spark, d), "l2").withColumn("value", F.round("value", 2))


@register("SELECT col_a, col_b, round(sum(CASE WHEN abs(a) + abs(b) > 1.1920929e-07 THEN abs(a - b) / (abs(a) + abs(b)) ELSE 0 END), 5) AS value FROM mp GROUP BY 1, 2", "mp")
def column_canberra(spark, d):
    return S.distance(T.matrix(spark, d), "canberra").withColumn("value", F.round("value", 5))


@register("SELECT 'brand' AS col_a, 'flag' AS col_b, round(avg(CASE WHEN length(p_brand) % 3 <> p_size % 3 THEN 1.0 ELSE 0.0 END), 6) AS value FROM part")
def column_hamming(spark, d):
    p = T.load(spark, d, "part")
    wide = p.select(F.col("p_partkey").alias("row"), (F.length("p_brand") % 3).alias("brand"), (F.col("p_size") % 3).alias("flag"))
    return r6(S.hamming(T.melt(wide, "row")), "value")


@register("SELECT x.set_id AS col_a, y.set_id AS col_b, round(log2(count(*) * any_value(n) / (any_value(x.k) * any_value(y.k))) / -log2(count(*) / any_value(n)), 6) AS value FROM (SELECT *, count(*) OVER (PARTITION BY set_id) AS k FROM items) x JOIN (SELECT *, count(*) OVER (PARTITION BY set_id) AS k FROM items) y ON x.item = y.item AND x.set_id < y.set_id, (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer) c GROUP BY 1, 2", "items")
def normalised_pmi(spark, d):
    return r6(S.pmi(_items(spark, d).select(F.col("item").alias("row"), F.col("set_id").alias("col")), T.cells(spark, d).count(), True), "value")


def _items(spark, d, by="p_brand"):
    c, p = T.counts(spark, d), T.load(spark, d, "part")
    return c.where("raw >= 60").join(p, c.gene == p.p_partkey).select(F.col(by).alias("set_id"), F.col("cell").alias("item")).distinct()


@register("SELECT x.s_suppkey AS row_a, y.s_suppkey AS row_b, round((CASE WHEN x.s_nationkey <> y.s_nationkey THEN 1.0 ELSE 0.0 END + abs(x.s_acctbal - y.s_acctbal) / g) / 2, 6) AS value FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey, (SELECT max(s_acctbal) - min(s_acctbal) AS g FROM supplier) r")
def row_gower(spark, d):
    s = T.load(spark, d, "supplier")
    m = T.melt(s.select(F.col("s_suppkey").alias("row"), F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance")), "row")
    kinds = spark.createDataFrame([("nation", True), ("balance", False)], "col string, is_cat boolean")
    return r6(S.gower(m, kinds), "value")


@register("SELECT p.row, q.row AS col, round((coalesce(l, 0) + coalesce(x.value, 0)) / (least(p.k, q.k) + 1 - coalesce(x.value, 0)), 6) AS value FROM (SELECT row, sum(value) AS k FROM aff GROUP BY 1) p JOIN (SELECT row, sum(value) AS k FROM aff GROUP BY 1) q ON p.row < q.row LEFT JOIN aff x ON x.row = p.row AND x.col = q.row LEFT JOIN (SELECT u.row, v.col, sum(u.value * v.value) AS l FROM aff u JOIN aff v ON u.col = v.row GROUP BY 1, 2) s ON s.row = p.row AND s.col = q.row WHERE x.value IS NOT NULL OR l IS NOT NULL", "aff")
def topological_overlap(spark, d):
    u = _und(spark, d)
    top = u.agg(F.max("w").alias("m"))
    return r6(S.topological_overlap(u.crossJoin(F.broadcast(top)).select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("w") / F.col("m")).alias("value")), True), "value")


_SIM = "SELECT set_a, set_b, nab / {below} AS value FROM (SELECT x.set_id AS set_a, y.set_id AS set_b, count(*) AS nab, any_value(x.k) AS na, any_value(y.k) AS nb FROM (SELECT *, count(*) OVER (PARTITION BY set_id) AS k FROM items) x JOIN (SELECT *, count(*) OVER (PARTITION BY set_id) AS k FROM types) y ON x.item = y.item GROUP BY 1, 2) z"


def _sim(spark, d, overlap=False):
    return S.set_similarity(_items(spark, d), _items(spark, d, "p_type"), overlap)


@register(f"SELECT set_a, set_b, round(value, 6) AS value FROM ({_SIM.format(below='(na + nb - nab)')}) q", "items", "types")
def set_jaccard(spark, d):
    return r6(_sim(spark, d), "value")


@register(f"SELECT set_a, set_b, round(value, 6) AS value FROM ({_SIM.format(below='least(na, nb)')}) q", "items", "types")
def set_overlap(spark, d):
    return r6(_sim(spark, d, True), "value")


@register(f"SELECT set_a, set_b, round(value, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY set_a) AS ma, max(value) OVER (PARTITION BY set_b) AS mb FROM ({_SIM.format(below='(na + nb - nab)')}) q) r WHERE value = ma AND value = mb", "items", "types")
def reciprocal_best_hits(spark, d):
    return r6(S.reciprocal_best(_sim(spark, d)), "value")


@register("SELECT set_a, set_b, round(value, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY set_a) AS ma, max(value) OVER (PARTITION BY set_b) AS mb FROM (SELECT x.col AS set_a, y.col AS set_b, abs(corr(x.value, y.value)) AS value FROM (SELECT * FROM m WHERE col IN ('size', 'price')) x JOIN (SELECT * FROM m WHERE col IN ('revenue', 'lines', 'discount')) y ON x.row = y.row GROUP BY 1, 2) q) r WHERE value = ma AND value = mb", "m")
def reciprocal_best_correlation(spark, d):
    m = T.matrix(spark, d)
    return r6(S.reciprocal_best_correlation(m.where("col IN ('size', 'price')"), m.where("col IN ('revenue', 'lines', 'discount')")), "value")


@register("SELECT col_a, col_b, round(ra, 6) AS r_a, round(rb, 6) AS r_b, round((atanh(ra) - atanh(rb)) / sqrt(1.0 / (na - 3) + 1.0 / (nb - 3)), 6) AS z FROM (SELECT col_a, col_b, corr(a, b) FILTER (WHERE one) AS ra, corr(a, b) FILTER (WHERE NOT one) AS rb, count(*) FILTER (WHERE one) AS na, count(*) FILTER (WHERE NOT one) AS nb FROM (SELECT mp.*, p_brand < 'Brand#33' AS one FROM mp JOIN part ON p_partkey = row) mp WHERE NOT (col_a = 'lines' AND col_b IN ('quantity', 'revenue')) GROUP BY 1, 2) z", "mp")
def differential_correlation(spark, d):
    out = S.differential_correlation(*_halves(spark, d)).where("NOT (col_a = 'lines' AND col_b IN ('quantity', 'revenue'))")
    return r6(out.drop("p"), "r_a", "r_b", "z")


def _halves(spark, d):
    m = T.matrix(spark, d).join(T.load(spark, d, "part").select(F.col("p_partkey").alias("row"), "p_brand"), "row")
    return m.where("p_brand < 'Brand#33'").drop("p_brand"), m.where("p_brand >= 'Brand#33'").drop("p_brand")


@register("SELECT feature, round(avg(j), 6) AS mean, round(stddev_pop(j), 6) AS sd FROM (SELECT p.feature, s / CAST(p.na + p.nb - s AS DOUBLE) AS j FROM (SELECT x.feature, x.run AS ra, y.run AS rb, x.cluster AS ca, y.cluster AS cb, x.n AS na, y.n AS nb, count(*) OVER (PARTITION BY x.run, y.run, x.cluster, y.cluster) AS s FROM (SELECT *, count(*) OVER (PARTITION BY run, cluster) AS n FROM members) x JOIN (SELECT *, count(*) OVER (PARTITION BY run, cluster) AS n FROM members) y ON x.feature = y.feature AND x.run < y.run) p) q GROUP BY 1", "members")
def cluster_stability(spark, d):
    p = T.load(spark, d, "part")
    runs = F.array(*[F.struct(F.lit(i).alias("run"), c.alias("cluster")) for i, c in enumerate((F.col("p_brand"), F.col("p_type"), F.floor(F.col("p_size") / 10).cast("string")))])
    m = p.select(F.col("p_partkey").alias("feature"), F.explode(runs).alias("r")).select("feature", "r.*")
    return r6(S.cluster_stability(m), "mean", "sd")


_BIN = "SELECT row, col, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((value - mn) / ((mx - mn) / 8)), 7) END AS INTEGER) AS bin FROM (SELECT *, min(value) OVER (PARTITION BY col) AS mn, max(value) OVER (PARTITION BY col) AS mx FROM m) z"


@register(_BIN, "m")
def bins_equal_width(spark, d):
    return I.bin_columns(T.matrix(spark, d, True), 8).select("row", "col", "bin")


@register("SELECT m.row, m.col, CAST(count(c.cut) AS INTEGER) AS bin FROM m LEFT JOIN (SELECT DISTINCT s.col, i, value AS cut FROM (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY col) AS n FROM m) s, (SELECT unnest(range(1, 8)) AS i) k WHERE r = (i * n) // 8) c ON c.col = m.col AND c.cut <= m.value GROUP BY 1, 2", "m")
def bins_equal_frequency(spark, d):
    return I.bin_columns(T.matrix(spark, d, True), 8, "equal_freq").select("row", "col", "bin")


@register(f"SELECT col, round(-sum(p * ln(p)), 6) AS value FROM (SELECT col, bin, count(*) / sum(count(*)) OVER (PARTITION BY col) AS p FROM ({_BIN}) b GROUP BY 1, 2) z GROUP BY 1", "m")
def column_entropy(spark, d):
    return r6(I.entropy(I.bin_columns(T.matrix(spark, d), 8)), "value")


@register(f"SELECT col_a, col_b, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi, round(-sum(nxy / n * ln(nxy / n)), 6) AS joint_entropy FROM (SELECT *, sum(nxy) OVER (PARTITION BY col_a, col_b) AS n, sum(nxy) OVER (PARTITION BY col_a, col_b, x) AS nx, sum(nxy) OVER (PARTITION BY col_a, col_b, y) AS ny FROM (SELECT p.col AS col_a, q.col AS col_b, p.bin AS x, q.bin AS y, CAST(count(*) AS DOUBLE) AS nxy FROM ({_BIN}) p JOIN ({_BIN}) q ON p.row = q.row AND p.col < q.col GROUP BY 1, 2, 3, 4) c) z GROUP BY 1, 2", "m")
def mutual_information(spark, d):
    return r6(I.mutual_information(I.bin_columns(T.matrix(spark, d), 8)), "mi", "joint_entropy")


# ---- statistics ------------------------------------------------------------------------------------------------------


@register("SELECT gene, round(least(min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS fdr FROM (SELECT gene, p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM (SELECT gene, 1 / (1 + exp(abs(stat) * 8)) AS p FROM stats) x) z", "stats")
def bh_fdr(spark, d):
    p = T.gene_stats(spark, d).select("gene", (1 / (1 + F.exp(F.abs("stat") * 8))).alias("p"))
    return K.with_fdr(p, "p").select("gene", F.round("fdr", 9).alias("fdr"))


@register("SELECT c_custkey AS id, abs(c_acctbal - md) > 1.5 * mad AS outlier FROM customer, (SELECT median(c_acctbal) AS md FROM customer) a, (SELECT median(abs(c_acctbal - (SELECT median(c_acctbal) FROM customer))) AS mad FROM customer) b")
def mad_outliers(spark, d):
    x = T.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return Z.mad_outliers(x, "x", 1.5).select("id", "outlier")


@register("SELECT gene, round(g * ((n - 3) / (n - 2.25)) * sqrt((n - 2) / n), 6) AS effect, round(sqrt(n / (na * nb) + g * g / (2 * n)), 6) AS se FROM (SELECT gene, na, nb, na + nb AS n, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS g FROM (SELECT l_partkey AS gene, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE l_returnflag <> 'N') AS DOUBLE) AS nb, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS ma, avg(l_quantity) FILTER (WHERE l_returnflag <> 'N') AS mb, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'N') AS va, var_samp(l_quantity) FILTER (WHERE l_returnflag <> 'N') AS vb FROM lineitem GROUP BY 1) x WHERE na > 2 AND nb > 2) z")
def hedges_effect(spark, d):
    x = T.load(spark, d, "lineitem").select(F.col("l_partkey").alias("gene"), "l_quantity", (F.col("l_returnflag") == "N").alias("new"))
    return r6(Z.hedges_g(x, "l_quantity", "new", ["gene"]), "effect", "se")


@register("SELECT p_brand AS brand, round(regr_intercept(p_retailprice, p_partkey), 4) AS intercept, round(regr_slope(p_retailprice, p_partkey), 6) AS slope FROM part GROUP BY 1")
def linear_regression(spark, d):
    p = T.load(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return D.regression(p, "x", "y", ("brand",)).select("brand", F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"))


@register("SELECT id, nbr, round(exp(-(dist * dist * 4)), 9) AS gaussian, round(CASE WHEN 2 * dist < 1 THEN exp(1 - 1 / (1 - 4 * dist * dist)) ELSE 0 END, 9) AS bump, round(1 / (1 + 4 * dist * dist), 9) AS inverse_quadratic FROM nn", "nn")
def rbf_kernels(spark, d):
    nn = _nn(spark, d)
    return nn.select("id", "nbr", *[F.round(K.rbf(F.col("dist"), F.lit(2.0), k), 9).alias(k) for k in K.RBF])


@register("SELECT epsilon, id, round(sum(exp(-pow(epsilon * dist, 2))), 6) AS total FROM (SELECT epsilon, unnest([id, nbr]) AS id, dist FROM dists, (SELECT unnest([0.5, 1.0, 2.0]) AS epsilon) e WHERE dists.id < nbr) z GROUP BY 1, 2", "dists")
def rbf_widths(spark, d):
    return r6(Z.rbf_scan_cosine(_points(spark, d), (0.5, 1.0, 2.0)), "total")


@register("SELECT cell, median, mad FROM (SELECT label AS cell, median(c_acctbal) AS median FROM cells JOIN customer ON c_custkey = cell GROUP BY 1) x JOIN (SELECT label AS cell, median(abs(c_acctbal - m)) AS mad FROM (SELECT label, c_acctbal, median(c_acctbal) OVER (PARTITION BY label) AS m FROM cells JOIN customer ON c_custkey = cell) y GROUP BY 1) z USING (cell)", "cells")
def grouped_median_mad(spark, d):
    x = T.load(spark, d, "customer").select(F.col("c_mktsegment").alias("cell"), F.col("c_acctbal").alias("x"))
    return Z.median_mad(x, "x", ["cell"])


@register("SELECT set_id, CAST(size AS BIGINT) AS size, round(p, 9) AS p FROM (SELECT set_id, any_value(m) AS size, CASE WHEN any_value(q) = 0 THEN 1 ELSE sum(exp(lgamma(m + 1.0) - lgamma(x + 1.0) - lgamma(m - x + 1.0) + lgamma(n - m + 1.0) - lgamma(k - x + 1.0) - lgamma(n - m - k + x + 1.0) - lgamma(n + 1.0) + lgamma(k + 1.0) + lgamma(n - k + 1.0))) END AS p FROM (SELECT set_id, m, n, k, q, unnest(range(q + 1, least(k, m) + 1)) AS x FROM (SELECT set_id, count(*) AS m, count(*) FILTER (WHERE gene IN (SELECT p_partkey FROM part WHERE p_size <= 7)) AS q, any_value(n) AS n, any_value(k) AS k FROM sets, (SELECT count(*) AS n, count(*) FILTER (WHERE p_size <= 7) AS k FROM part) p GROUP BY 1) a) b GROUP BY 1) c", "sets")
def hypergeometric_tail(spark, d):
    s = T.load(spark, d, "part").select(F.col("p_brand").alias("set_id"), (F.col("p_size") <= 7).cast("long").alias("hit"))
    total = s.agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    x = s.groupBy("set_id").agg(F.count("*").alias("size"), F.sum("hit").alias("q")).crossJoin(F.broadcast(total))
    return x.select("set_id", "size", F.round(hypergeom_col(F.col("q"), F.col("size"), F.col("n") - F.col("size"), F.col("k")), 9).alias("p"))


def _target(spark, d):
    return T.load(spark, d, "part").where("p_size <= 7").select(F.col("p_partkey").alias("gene"))


# ---- graphs ------------------------------------------------------------------------------------------------------------


def _und(spark, d):
    return G.both_ways(T.edges(spark, d).where("src < dst"))


@register("SELECT src AS id, count(*) AS degree, sum(w) AS strength FROM und GROUP BY 1", "und")
def node_degrees(spark, d):
    return G.degrees(_und(spark, d))


@register("SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS w FROM und", "und")
def transition_matrix(spark, d):
    return G.transition(_und(spark, d)).withColumn("w", F.round("w", 9))


@register("SELECT id AS row, id AS col, d AS value FROM deg UNION ALL SELECT src, dst, -w FROM und", "deg")
def graph_laplacian(spark, d):
    return G.laplacian(_und(spark, d))


@register("SELECT id AS row, id AS col, 1.0 AS value FROM deg UNION ALL SELECT src, dst, round(-w / sqrt(p.d * q.d), 9) FROM und JOIN deg p ON p.id = src JOIN deg q ON q.id = dst", "deg")
def normalised_laplacian(spark, d):
    return G.laplacian(_und(spark, d), True).withColumn("value", F.round("value", 9))


@register("SELECT row, col, sum(value) AS value FROM (SELECT row, col, value / 2 AS value FROM t UNION ALL SELECT col, row, value / 2 FROM t) z GROUP BY 1, 2", "t")
def knn_adjacency(spark, d):
    return G.knn_adjacency(_und(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("value")), 4)


@register("SELECT src, dst, w FROM (SELECT least(id, nbr) AS a, greatest(id, nbr) AS b, CAST(count(*) AS DOUBLE) AS w FROM nn GROUP BY 1, 2) z, LATERAL (SELECT a AS src, b AS dst UNION ALL SELECT b, a) y", "nn")
def knn_graph(spark, d):
    return G.knn_graph(_nn(spark, d))


@register("WITH RECURSIVE " + sql("", "nn").removeprefix("WITH ").rstrip() + ", h AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS hops UNION SELECT nn.nbr, h.hops + 1 FROM h JOIN nn ON nn.id = h.id WHERE h.hops < 12) SELECT id, min(hops) AS hops FROM h GROUP BY 1")
def hop_distances(spark, d):
    e = cut(_nn(spark, d).select(F.col("id").alias("src"), F.col("nbr").alias("dst")))
    return G.hop_distances(e, spark.createDataFrame([(0,)], "id long"), 12)


# ---- enrichment ----------------------------------------------------------------------------------------------------


_HITS = "SELECT r.*, set_id, count(*) OVER (PARTITION BY set_id) AS size, CAST(count(*) OVER () AS BIGINT) AS unused, n FROM ranked r JOIN sets USING (gene), (SELECT count(*) AS n FROM stats) c"
_WALK = f"SELECT set_id, size, cum - (pos - i) / CAST(n - size AS DOUBLE) AS top, cum - (pos - i) / CAST(n - size AS DOUBLE) - x AS bottom FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY pos) AS i, sum(x) OVER (PARTITION BY set_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, abs(stat) / sum(abs(stat)) OVER (PARTITION BY set_id) AS x FROM ({_HITS}) h) y) z"


@register(f"SELECT set_id, CAST(any_value(size) AS BIGINT) AS size, round(CASE WHEN max(top) > -min(bottom) THEN max(top) WHEN max(top) < -min(bottom) THEN min(bottom) ELSE 0 END, 6) AS es FROM ({_WALK}) w GROUP BY 1", "ranked", "sets")
def enrichment_scores(spark, d):
    return r6(E.enrichment_scores(T.gene_stats(spark, d), T.gene_sets(spark, d)), "es")


@register("SELECT set_id, CAST(m AS BIGINT) AS size, CAST(h AS BIGINT) AS hits, round((h * (n - m - k + h)) / CAST((k - h) * (m - h) AS DOUBLE), 6) AS odds FROM (SELECT set_id, count(*) AS m, count(*) FILTER (WHERE gene IN (SELECT p_partkey FROM part WHERE p_size <= 7)) AS h, any_value(n) AS n, any_value(k) AS k FROM sets, (SELECT count(*) AS n, count(*) FILTER (WHERE p_size <= 7) AS k FROM part) p GROUP BY 1) z WHERE h >= 2", "sets")
def over_representation(spark, d):
    s = T.gene_sets(spark, d)
    out = E.over_representation(s, _target(spark, d), s.select("gene"), min_overlap=2)
    return r6(out.select("set_id", "size", "hits", "odds"), "odds")


_EXPR = "SELECT l_partkey AS gene, l_returnflag || l_linestatus AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"


def _expression(spark, d):
    return T.load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.sum("l_quantity").alias("value"))


@register(f"SELECT set_id, sample, round(score / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM (SELECT set_id, sample, sum(wt * lft) / sum(wt) - (any_value(n) * (any_value(n) + 1) / 2.0 - sum(lft)) / (any_value(n) - count(*)) AS score FROM (SELECT gene, sample, pow(rk, 0.25) AS wt, n - pos + 1 AS lft, n FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY sample) AS n, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS pos FROM ({_EXPR}) e) r) q JOIN sets USING (gene) GROUP BY 1, 2) z", "sets")
def single_sample_enrichment(spark, d):
    return r6(E.single_sample_scores(_expression(spark, d), T.gene_sets(spark, d)), "score")


@register(f"SELECT set_id, sample, round(greatest(max(top), 0) + least(min(low), 0), 6) AS score FROM (SELECT set_id, sample, cum / total - (pos - i) / CAST(n - k AS DOUBLE) AS top, (cum - wt) / total - (pos - i) / CAST(n - k AS DOUBLE) AS low FROM (SELECT *, row_number() OVER (PARTITION BY set_id, sample ORDER BY pos) AS i, count(*) OVER (PARTITION BY set_id, sample) AS k, sum(wt) OVER (PARTITION BY set_id, sample) AS total, sum(wt) OVER (PARTITION BY set_id, sample ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT gene, sample, n, pos, abs(n - pos + 1 - n / 2.0) AS wt FROM (SELECT *, count(*) OVER (PARTITION BY sample) AS n, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS pos FROM ({_EXPR}) e) r) q JOIN sets USING (gene)) y) z GROUP BY 1, 2", "sets")
def set_variation_ranks(spark, d):
    return r6(E.set_variation(_expression(spark, d), T.gene_sets(spark, d), kernel=False), "score")


_CONTRAST = f"SELECT gene, sample AS contrast, value - 100 AS value FROM ({_EXPR}) e"


@register(f"SELECT gene, contrast, rank() OVER (PARTITION BY contrast ORDER BY value) + (count(*) OVER (PARTITION BY contrast, value) - 1) / 2.0 - sum(CASE WHEN value < 0 THEN 1.0 WHEN value = 0 THEN 0.5 ELSE 0 END) OVER (PARTITION BY contrast) AS rank FROM ({_CONTRAST}) c")
def contrast_ranks(spark, d):
    return E.contrast_ranks(_expression(spark, d).select("gene", F.col("sample").alias("contrast"), (F.col("value") - 100).alias("value")))


_RANKS = f"SELECT sample AS motif, gene, CAST(row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS INTEGER) AS rank FROM ({_EXPR}) e"


def _motif_ranks(spark, d):
    w = Window.partitionBy("sample").orderBy(F.desc("value"), "gene")
    return _expression(spark, d).select(F.col("sample").alias("motif"), "gene", F.row_number().over(w).alias("rank"))


@register(f"SELECT motif, round(auc, 9) AS auc, round((auc - avg(auc) OVER ()) / stddev_samp(auc) OVER (), 6) AS nes FROM (SELECT motif, sum((nxt - rank) * i) / CAST(150 * any_value(k) AS DOUBLE) AS auc FROM (SELECT motif, rank, row_number() OVER (PARTITION BY motif ORDER BY rank, gene) AS i, coalesce(lead(rank) OVER (PARTITION BY motif ORDER BY rank, gene), 150) AS nxt FROM ({_RANKS}) r WHERE gene IN (SELECT p_partkey FROM part WHERE p_size <= 7) AND rank < 150) y, (SELECT count(DISTINCT l_partkey) AS k FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 7)) c GROUP BY 1) z")
def recovery_auc(spark, d):
    ranks = _motif_ranks(spark, d)
    out = E.recovery_scores(E.recovery_auc(ranks, _target(spark, d).join(ranks, "gene", "left_semi"), 150))
    return out.select("motif", F.round("auc", 9).alias("auc"), F.round("nes", 6).alias("nes"))


# ---- ontology ------------------------------------------------------------------------------------------------------


_CLOSURE = f"WITH RECURSIVE onto AS ({CTE['onto']}), terms AS (SELECT child AS term FROM onto UNION SELECT parent FROM onto), up AS (SELECT term, term AS ancestor, CAST(1.0 AS DOUBLE) AS s FROM terms UNION SELECT up.term, onto.parent, up.s * onto.w FROM up JOIN onto ON onto.child = up.ancestor)"


@register(_CLOSURE + " SELECT DISTINCT term, ancestor FROM up")
def term_ancestors(spark, d):
    return O.ancestors(T.ontology_edges(spark, d))


@register("SELECT term, round(-ln(count(DISTINCT gene) / CAST(any_value(n) AS DOUBLE)), 6) AS ic FROM tg, (SELECT count(*) AS n FROM customer) c GROUP BY 1", "tg")
def information_content(spark, d):
    return r6(O.information_content(T.term_genes(spark, d)), "ic")


def _term_pairs(spark, d):
    n = T.load(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("term_a")), n.select(F.col("n_name").alias("term_b"))
    return a.crossJoin(b).where("term_a < term_b")


_SIMILAR = _CLOSURE + f", tg AS ({CTE['tg']}), ic AS (SELECT term, -ln(count(DISTINCT gene) / CAST(any_value(n) AS DOUBLE)) AS ic FROM tg, (SELECT count(*) AS n FROM customer) c GROUP BY 1), pr AS (SELECT a.n_name AS term_a, b.n_name AS term_b FROM nation a JOIN nation b ON a.n_name < b.n_name), mica AS (SELECT term_a, term_b, max(ic.ic) AS mica FROM pr JOIN (SELECT DISTINCT term, ancestor FROM up) x ON x.term = term_a JOIN (SELECT DISTINCT term, ancestor FROM up) y ON y.term = term_b AND y.ancestor = x.ancestor JOIN ic ON ic.term = x.ancestor GROUP BY 1, 2)"


@register(_SIMILAR + " SELECT term_a, term_b, round(2 * mica / (p.ic + q.ic), 6) AS value FROM mica JOIN ic p ON p.term = term_a JOIN ic q ON q.term = term_b")
def semantic_similarity_lin(spark, d):
    e = T.ontology_edges(spark, d)
    return r6(O.similarity(_term_pairs(spark, d), O.ancestors(e), O.information_content(T.term_genes(spark, d)), "lin"), "value")


@register(_SIMILAR + " SELECT term_a, term_b, round(mica / (SELECT max(ic) FROM ic), 6) AS value FROM mica")
def semantic_similarity_resnik(spark, d):
    e = T.ontology_edges(spark, d)
    return r6(O.similarity(_term_pairs(spark, d), O.ancestors(e), O.information_content(T.term_genes(spark, d)), "resnik"), "value")


@register(_CLOSURE + ", sv AS (SELECT term, ancestor, max(s) AS s FROM up GROUP BY 1, 2), tot AS (SELECT term, sum(s) AS t FROM sv GROUP BY 1) SELECT x.term AS term_a, y.term AS term_b, round(sum(x.s + y.s) / any_value(p.t + q.t), 6) AS value FROM sv x JOIN sv y ON x.ancestor = y.ancestor AND x.term < y.term JOIN tot p ON p.term = x.term JOIN tot q ON q.term = y.term GROUP BY 1, 2")
def wang_similarity(spark, d):
    return r6(O.wang(T.ontology_edges(spark, d)), "value")


# ---- neighbours ----------------------------------------------------------------------------------------------------


def _points(spark, d):
    return T.embedding(spark, d)


def _batches(spark, d):
    return _points(spark, d).select("id", F.col("label").alias("batch"))


def _nn(spark, d):
    return N.knn(_points(spark, d), 10, "cosine")


@register("SELECT id, rank, nbr, round(dist, 6) AS dist FROM nn", "nn")
def knn_exact(spark, d):
    return r6(_nn(spark, d), "dist")


@register("SELECT src, dst, s / (22.0 - s) AS w FROM (SELECT x.id AS src, y.id AS dst, count(*) AS s FROM (SELECT id, nbr FROM nn UNION ALL SELECT DISTINCT id, id FROM nn) x JOIN (SELECT id, nbr FROM nn UNION ALL SELECT DISTINCT id, id FROM nn) y ON x.nbr = y.nbr AND x.id < y.id GROUP BY 1, 2) z WHERE s / (22.0 - s) >= 0.1", "nn")
def snn_jaccard(spark, d):
    return N.snn_graph(_nn(spark, d), 10, "jaccard", 0.1)


@register("SELECT src, dst, greatest(10 - m, 1e-6) / 10 AS w FROM (SELECT x.id AS src, y.id AS dst, min((x.rank + y.rank) / 2.0) AS m FROM (SELECT id, nbr, rank FROM nn UNION ALL SELECT DISTINCT id, id, 0 FROM nn) x JOIN (SELECT id, nbr, rank FROM nn UNION ALL SELECT DISTINCT id, id, 0 FROM nn) y ON x.nbr = y.nbr AND x.id < y.id GROUP BY 1, 2) z WHERE (src, dst) IN (SELECT least(id, nbr), greatest(id, nbr) FROM nn)", "nn")
def snn_rank_limited(spark, d):
    return N.snn_graph(_nn(spark, d), 10, "rank", 0.0, True)


@register("SELECT id, round(1 / sum(p * p), 6) AS lisi FROM (SELECT nn.id, batch, count(*) / CAST(sum(count(*)) OVER (PARTITION BY nn.id) AS DOUBLE) AS p FROM nn JOIN points ON points.id = nbr GROUP BY nn.id, batch) z GROUP BY 1", "nn")
def batch_lisi(spark, d):
    return r6(N.lisi(_nn(spark, d), _batches(spark, d)), "lisi")


@register("SELECT g.id, round(sum((coalesce(n, 0) - 10 * share) * (coalesce(n, 0) - 10 * share) / (10 * share)), 6) AS chi2 FROM (SELECT DISTINCT id FROM nn) g CROSS JOIN (SELECT batch, count(*) / CAST((SELECT count(*) FROM points) AS DOUBLE) AS share FROM points GROUP BY 1) s LEFT JOIN (SELECT nn.id, batch, count(*) AS n FROM nn JOIN points ON points.id = nbr GROUP BY nn.id, batch) c ON c.id = g.id AND c.batch = s.batch GROUP BY 1", "nn")
def kbet_statistic(spark, d):
    return r6(N.kbet(_nn(spark, d), _batches(spark, d)).select("id", "chi2"), "chi2")


@register("SELECT id, round((b - a) / greatest(a, b), 6) AS silhouette FROM (SELECT id, max(CASE WHEN own = other THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM (SELECT x.id, x.batch AS own, y.batch AS other, sum(list_distance(x.vec, y.vec)) AS s FROM points x, points y GROUP BY 1, 2, 3) d JOIN (SELECT batch, count(*) AS n FROM points GROUP BY 1) c ON c.batch = other GROUP BY 1) z", "points")
def batch_silhouette(spark, d):
    return r6(N.silhouette(_points(spark, d).select("id", "vec"), _batches(spark, d)), "silhouette")


@register("WITH points AS (" + CTE["points"] + "), l AS (SELECT * FROM points WHERE batch = 0), r AS (SELECT * FROM points WHERE batch = 1), q AS (SELECT l.id AS left_id, r.id AS right_id, row_number() OVER (PARTITION BY l.id ORDER BY round(list_distance(l.vec, r.vec), 12), r.id) AS i, row_number() OVER (PARTITION BY r.id ORDER BY round(list_distance(l.vec, r.vec), 12), l.id) AS j FROM l, r) SELECT left_id, right_id FROM q WHERE i <= 5 AND j <= 5")
def mutual_neighbours(spark, d):
    p = _points(spark, d)
    out = N.mutual_neighbours(p.where("label = 0").select("id", "vec"), p.where("label = 1").select("id", "vec"), 5)
    return out.select(F.col("left").alias("left_id"), F.col("right").alias("right_id"))


@register("SELECT id AS src, nbr AS dst, round(exp(-(dist * dist) / (max(dist) OVER (PARTITION BY id) * max(dist) OVER (PARTITION BY id))), 6) AS w FROM nn", "nn")
def neighbour_kernel(spark, d):
    return r6(H.graph_weights(_nn(spark, d)), "w")


@register("SELECT least(id, nbr) AS src, greatest(id, nbr) AS dst, round(sum(w), 6) AS w FROM (SELECT id, nbr, exp(-(dist * dist) / (max(dist) OVER (PARTITION BY id) * max(dist) OVER (PARTITION BY id))) AS w FROM nn) z GROUP BY 1, 2", "nn")
def non_redundant_weights(spark, d):
    return r6(H.non_redundant(H.graph_weights(_nn(spark, d))), "w")
