"""Registered queries that SQL can't express: fits, permutation nulls, iterations, seeded simulations. Tests hold them to
brute force, invariants or planted structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe import tables as T
from helixframe.functions.special import z_pvalue_col
from helixframe.operators import cells as C
from helixframe.operators import communities as Q
from helixframe.operators import decomposition as D
from helixframe.operators import doublets as B
from helixframe.operators import enrichment as E
from helixframe.operators import fusion as U
from helixframe.operators import graph as G
from helixframe.operators import hotspot as H
from helixframe.operators import krylov as Y
from helixframe.operators import matrix as M
from helixframe.operators import metacells as A
from helixframe.operators import neighbours as N
from helixframe.operators import ontology as O
from helixframe.operators import regulation as R
from helixframe.operators import similarity as S
from helixframe.operators import stats as Z
from helixframe.operators import trees as L
from helixframe.plans.checkpoint import cut, scratch
from helixframe.sources import formats, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


#: Squared change at which the nine digits of a rank stand.
SETTLED = 1e-20


def register(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _norm(spark, d):
    return C.normalise(T.counts(spark, d))


def _points(spark, d):
    return T.embedding(spark, d).select("id", "vec")


def _batches(spark, d):
    return T.embedding(spark, d).select("id", F.col("label").alias("batch"))


def _nn(spark, d, k=10, metric="cosine"):
    return cut(N.knn(_points(spark, d), k, metric))


def _und(spark, d):
    return cut(G.both_ways(T.edges(spark, d).where("src < dst")))


@register
def variable_genes(spark, d):
    return rounded(C.variable_genes(T.counts(spark, d), T.cells(spark, d).count()), 4, "mean", "var", "expected", "var_std")


@register
def variable_genes_by_batch(spark, d):
    return rounded(C.variable_genes_by_batch(T.counts(spark, d), T.cells(spark, d).select("cell", "batch")), 4, "mean", "var", "expected", "var_std")


@register
def selected_genes(spark, d):
    return C.select_variable(C.variable_genes(T.counts(spark, d), T.cells(spark, d).count(), most=64))  # as its SQL has it


@register
def critical_value(spark, d):
    return Z.critical_value(T.gene_stats(spark, d), "stat", 5000, 0.05)


@register
def z_pvalues(spark, d):
    return rounded(T.gene_stats(spark, d).select("gene", (F.col("stat") * 10).alias("z")).withColumn("p", z_pvalue_col(F.col("z"))), 9, "z", "p")


@register
def differential_correlation_pvalues(spark, d):
    m = T.matrix(spark, d).join(T.load(spark, d, "part").select(F.col("p_partkey").alias("row"), "p_brand"), "row")
    return rounded(S.differential_correlation(m.where("p_brand < 'Brand#33'").drop("p_brand"), m.where("p_brand >= 'Brand#33'").drop("p_brand")), 6, "r_a", "r_b", "z", "p")


# ---- decompositions ------------------------------------------------------------------------------------------------


@register
def principal_components(spark, d):
    return D.pca(_points(spark, d), 10)[0]


@register
def singular_values(spark, d):
    s, _ = D.randomised_svd(_points(spark, d), 10)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "component int, value double")


@register
def sparse_singular_values(spark, d):
    s, _, _ = Y.sparse_randomised_svd(_norm(spark, d), T.cells(spark, d).count(), 10)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "component int, value double")


@register
def cell_components(spark, d):
    norm, n = _norm(spark, d), T.cells(spark, d).count()
    return D.cell_components(norm.join(C.select_variable(C.variable_genes(T.counts(spark, d), n)), "gene", "left_semi"), n, 10)


@register
def independent_components(spark, d):
    return D.stabilised_ica(_points(spark, d), 5, 4)


@register
def independent_components_folds(spark, d):
    return D.stabilised_ica(_points(spark, d), 3, 2, "exp", folds=3)


@register
def independent_components_by_passes(spark, d):
    return D.ica_by_passes(_points(spark, d), 4, 3, rounds=20)


# ---- graphs --------------------------------------------------------------------------------------------------------


@register
def page_rank(spark, d):
    return rounded(G.page_rank(_und(spark, d), tol=SETTLED), 9, "rank")


@register
def personalised_page_rank(spark, d):
    return rounded(G.page_rank(_und(spark, d), spark.createDataFrame([(0, 1.0), (3, 2.0)], "id long, p double")), 9, "rank")


@register
def constrained_page_rank(spark, d):
    e = _und(spark, d).withColumn("etype", F.when(F.col("w") > F.lit(20), "strong").otherwise("weak"))
    types = G.nodes_of(e).withColumn("ntype", F.when(F.col("id") % 5 == 0, "sink").otherwise("open"))
    return rounded(G.constrained_page_rank(e, types, spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, p double"), sink_types=["sink"], absorbing=["weak"], tol=SETTLED), 9, "rank")


@register
def tied_diffusion(spark, d):
    p = lambda *x: spark.createDataFrame([(i, 1.0) for i in x], "id long, p double")
    return rounded(G.tied_diffusion(_und(spark, d), p(0, 1), p(2, 3), "mean"), 9, "score")


@register
def label_spreading(spark, d):
    labels = _batches(spark, d).withColumn("labelled", F.col("id") % 4 == 0)
    classes = labels.select(F.col("batch").alias("cls")).distinct()
    grid = labels.crossJoin(F.broadcast(classes)).select("id", "cls", F.when(F.col("labelled") & (F.col("batch") == F.col("cls")), 1.0).otherwise(0.0).alias("y"), "labelled")
    weights = G.neighbour_weights(_nn(spark, d).select(F.col("id").alias("src"), F.col("nbr").alias("dst")), True)
    return rounded(G.label_spreading(cut(weights), grid, 0.9, 12, tol=0.0, max_hops=6), 9, "value")


@register
def connected_components(spark, d):
    return G.connected_components(N.snn_graph(_nn(spark, d), 10, "jaccard", 0.3))


@register
def louvain(spark, d):
    return G.louvain(G.knn_graph(_nn(spark, d)))


@register
def walktrap(spark, d):
    return G.walktrap(_und(spark, d), 3, 4, "average")


@register
def spectral_clusters(spark, d):
    return G.spectral(_und(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("value")), 5, 3)


@register
def coarse_graph(spark, d):
    return G.coarsen(G.knn_graph(_nn(spark, d)))[0]


@register
def edge_matching(spark, d):
    return Q.matching(_und(spark, d))


@register
def sign_groups(spark, d):
    return G.sign_groups(S.correlation(T.matrix(spark, d)))


# ---- enrichment ----------------------------------------------------------------------------------------------------


@register
def gsea_permutations(spark, d):
    return E.gsea(T.gene_stats(spark, d), T.gene_sets(spark, d), 200)


@register
def gsea_multilevel(spark, d):
    return E.gsea_multilevel(T.gene_stats(spark, d), T.gene_sets(spark, d), 51)


@register
def leading_edges(spark, d):
    out = E.enrichment_scores(T.gene_stats(spark, d), T.gene_sets(spark, d), leading_edge=True)
    return rounded(out, 6, "es").withColumn("leading_edge", F.array_join("leading_edge", ","))


def _expression(spark, d):
    return T.load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.sum("l_quantity").alias("value"))


@register
def set_variation(spark, d):
    dense = E.kernel_density(_expression(spark, d)).withColumn("value", F.round("value", 4))
    return rounded(E.set_variation(dense, T.gene_sets(spark, d), kernel=False), 6, "score")


@register
def set_variation_poisson(spark, d):
    dense = E.kernel_density(_expression(spark, d), gaussian=False).withColumn("value", F.round("value", 4))
    return rounded(E.set_variation(dense, T.gene_sets(spark, d), kernel=False), 6, "score")


@register
def over_representation_pvalues(spark, d):
    s = T.gene_sets(spark, d)
    out = E.over_representation(s, T.load(spark, d, "part").where("p_size <= 7").select(F.col("p_partkey").alias("gene")), s.select("gene"))
    return rounded(rounded(out, 6, "odds"), 9, "p", "fdr")


@register
def multi_contrast(spark, d):
    return E.multi_contrast(_expression(spark, d).select("gene", F.col("sample").alias("contrast"), (F.col("value") - 100).alias("value")), T.gene_sets(spark, d))


@register
def motif_enrichment(spark, d):
    from pyspark.sql import Window

    ranks = T.counts(spark, d).select(F.col("cell").alias("motif"), "gene", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("raw"), "gene")).alias("rank"))
    out = E.motif_enrichment(ranks, T.gene_sets(spark, d).where("set_id = 'Brand#11'").select("gene"), 30, 0.5, 50)
    return rounded(rounded(out, 9, "auc"), 6, "nes").withColumn("leading_edge", F.array_join("leading_edge", ","))


@register
def ontology_elimination(spark, d):
    e, tg = T.ontology_edges(spark, d), T.term_genes(spark, d)
    target = T.load(spark, d, "customer").where("c_acctbal > 7000").select(F.col("c_custkey").alias("gene"))
    return rounded(O.elimination(tg, O.ancestors(e), O.levels(e), target), 9, "p", "fdr")


@register
def ontology_elimination_gsea(spark, d):
    e, tg = T.ontology_edges(spark, d), T.term_genes(spark, d)
    stats = T.load(spark, d, "customer").select(F.col("c_custkey").alias("gene"), (F.col("c_acctbal") - 4500.0).alias("stat"))
    return O.elimination_gsea(stats, tg, O.ancestors(e), O.levels(e), 100)


@register
def ontology_levels(spark, d):
    return O.levels(T.ontology_edges(spark, d))


# ---- neighbours and batches ----------------------------------------------------------------------------------------


@register
def knn_approximate(spark, d):
    return N.knn(_points(spark, d), 10, "cosine", method="lsh")


@register
def knn_recall(spark, d):
    """method, recall against the exact neighbours."""
    exact, out = _nn(spark, d), None
    for method in N.METHODS[1:]:
        one = N.recall(N.knn(_points(spark, d), 10, "cosine", method=method), exact).select(F.lit(method).alias("method"), "recall")
        out = one if out is None else out.union(one)
    return out


@register
def knn_leaves(spark, d):
    return N.knn(_points(spark, d), 10, "cosine", method="annoy")


@register
def knn_cells(spark, d):
    return N.knn(_points(spark, d), 10, "cosine", method="ivf")


@register
def knn_descent(spark, d):
    return N.knn(_points(spark, d), 10, "cosine", method="nndescent")


@register
def knn_saved_index(spark, d):
    """All cells of an index that was saved and read again."""
    path = scratch(spark, "index")
    N.save_index(_points(spark, d), path)
    return rounded(N.search_index(spark, path, _points(spark, d), 10, probes=1_000_000, own=True), 9, "dist")


@register
def kbet_pvalues(spark, d):
    return rounded(N.kbet(_nn(spark, d), _batches(spark, d)), 6, "chi2", "p")


@register
def batch_balanced_graph(spark, d):
    return N.bbknn(_points(spark, d), _batches(spark, d).withColumn("batch", F.col("batch") % 3))[1]


@register
def fast_mnn(spark, d):
    return N.fast_mnn(_points(spark, d), _batches(spark, d).withColumn("batch", F.col("batch") % 2), 10)


@register
def harmony(spark, d):
    return N.harmony(_points(spark, d), _batches(spark, d).withColumn("batch", F.col("batch") % 2), 5, rounds=2)


@register
def neighbourhoods(spark, d):
    nn = _nn(spark, d)
    return N.neighbourhood_matrix(nn, N.sample_neighbourhoods(_points(spark, d), nn))


# ---- doublets, metacells, autocorrelation, regulation --------------------------------------------------------------


@register
def scrublet(spark, d):
    return B.scrublet(T.counts(spark, d), ratio=1.0, components=10)


@register
def boosted_doublets(spark, d):
    return B.boosted_doublets(T.counts(spark, d), rounds=2, components=10)


@register
def bootstrap_metacells(spark, d):
    return A.bootstrap_metacells(_nn(spark, d), 5, 40)


@register
def super_cells(spark, d):
    return A.super_cells(cut(N.knn(_points(spark, d), 8, "cosine")), 20)


@register
def kernel_archetypes(spark, d):
    return A.archetypes(cut(N.knn(_points(spark, d), 10, "euclidean")), 8, rounds=3, steps=15, min_rounds=2)[0]


def _spatial(spark, d):
    counts = cut(T.counts(spark, d))
    cells = T.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal"), F.col("c_nationkey") * 100.0).alias("vec"))
    umi = cut(counts.groupBy("cell").agg(F.sum("raw").cast("double").alias("umi")))
    cells = cut(cells.join(umi.select(F.col("cell").alias("id")), "id", "left_semi"))
    return counts, umi, cut(H.graph_weights(N.knn(cells, 8, "euclidean")))


@register
def gene_autocorrelation(spark, d):
    counts, umi, w = _spatial(spark, d)
    return rounded(H.sparse_autocorrelation(counts, umi, w, "danb"), 6, "g", "c", "z", "p", "fdr")


@register
def gene_autocorrelation_bernoulli(spark, d):
    counts, umi, w = _spatial(spark, d)
    return rounded(H.sparse_autocorrelation(counts, umi, w, "bernoulli"), 6, "g", "c", "z", "p", "fdr")


@register
def gene_pair_modules(spark, d):
    counts, umi, w = _spatial(spark, d)
    top = C.select_variable(C.variable_genes(counts, umi.count()), 0.97)
    return H.gene_modules(cut(H.sparse_pair_correlation(counts, umi, w, top)), 0.5, 3)


@register
def signature_autocorrelation(spark, d):
    norm, n = _norm(spark, d), T.load(spark, d, "part").count()
    _, _, w = _spatial(spark, d)
    signs = T.gene_sets(spark, d).withColumn("sign", F.when(F.col("gene") % 2 == 0, 1.0).otherwise(-1.0))
    back = T.gene_sets(spark, d).select(F.concat(F.lit("bg"), (F.col("gene") % 20).cast("string")).alias("set_id"), "gene", F.lit(1.0).alias("sign"))
    s = C.signature_scores(norm, signs, n).withColumn("cluster", F.lit(0))
    b = C.signature_scores(norm, back, n).withColumn("cluster", F.lit(0))
    return H.signature_autocorrelation(s, b, w)


@register
def regulatory_network(spark, d):
    norm = _norm(spark, d)
    regulators = T.load(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("gene"))
    targets = C.expressed_genes(T.counts(spark, d), T.cells(spark, d).count(), 50, 0.03)
    return R.regulatory_network(norm, T.cells(spark, d), regulators, targets, "rf", 10, 4, 10)


@register
def regulatory_network_boosted(spark, d):
    norm = _norm(spark, d)
    regulators = T.load(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("gene"))
    targets = C.expressed_genes(T.counts(spark, d), T.cells(spark, d).count(), 50, 0.03)
    return R.regulatory_network(norm, T.cells(spark, d), regulators, targets, "grnboost2", 20, 3, 10, subsample=0.9, rate=0.1, by_levels=False)


@register
def tree_root_splits(spark, d):
    """One level of trees over all cells, the genes of a brand sharing one: the best split of all regulators and bins."""
    norm, own = _norm(spark, d), T.cells(spark, d).select("cell").distinct()
    regulators = T.load(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("gene"))
    bins = cut(L.quantised(norm, regulators, own))
    brand = T.gene_sets(spark, d).select("gene", F.regexp_extract("set_id", "[0-9]+", 0).cast("int").alias("batch"))
    y = cut(norm.join(brand, "gene").select("batch", "cell", F.col("gene").alias("target"), F.col("norm").cast("double").alias("v")))
    state = cut(L.planted(own, y.select("batch"), [0], 1.0, False, 0))
    sizes = state.groupBy(*L.NODE).agg(F.sum("w").cast("long").alias("n"))
    sums = y.groupBy("batch", F.lit(0).alias("tree"), F.lit(1).cast("long").alias("node"), "target").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    best = L.best_splits(cut(L.histogram(state, bins, y)), sizes, sums, 2)
    return best.select("batch", "tf", "bin", F.round("gain", 6).alias("gain"), "n", "n_right")


@register
def gene_batches(spark, d):
    return R.batches_of_genes(_norm(spark, d), T.cells(spark, d).count(), 64, "random")


# ---- fusion and dictionaries ---------------------------------------------------------------------------------------


@register
def dictionary_learning(spark, d):
    m = T.edges(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("value"))
    return U.dictionary_grid(m, (3, 5), (3,), (1, 2), rounds=3)


# ---- sources -------------------------------------------------------------------------------------------------------


@register
def combined_sources(spark, d):
    c = T.counts(spark, d)
    return store.combine([c.where("cell % 2 = 0"), c.where("cell % 2 = 1")], 10, 10, 100)


def _h5ad(spark, d, normalised):
    """The counts through h5ad files of 512 cells each, csr and csc, their genes and cells named again after the union."""
    known = cut(formats.write_h5ad(T.counts(spark, d), scratch(spark, "h5ad"), normalised=normalised))
    files = known.select("file", "path", "layout").distinct().orderBy("file").collect()  # a row a file
    number = spark.createDataFrame([(i, r.file) for i, r in enumerate(files)], "at int, file int")
    names = known.join(F.broadcast(number), "file").select(F.col("at").alias("file"), "kind", "old", "new")
    read = formats.h5ad(spark, [r.path for r in files], [r.layout for r in files], 100, "total" if normalised else None)
    genes = names.where("kind = 'gene'").select("file", F.col("new").alias("gene"), F.col("old").alias("universe"))
    out = formats.h5ad_union([read], genes, 10, 10, 100)
    cells = names.where("kind = 'cell'").select("file", F.col("new").alias("cell"), F.col("old").alias("name"))
    return out.join(cells, ["file", "cell"]).select(F.col("name").alias("cell"), "gene", "raw")


@register
def h5ad_files(spark, d):
    return _h5ad(spark, d, False)


@register
def h5ad_normalised_files(spark, d):
    return _h5ad(spark, d, True)


@register
def synthetic_cells(spark, d):
    return formats.synthetic_cells(spark, 200, 300)


@register
def synthetic_bulk(spark, d):
    return formats.dropout(formats.synthetic_bulk(spark, 20, 100, (10, 10)))


@register
def walk_distributions(spark, d):
    return rounded(G.walk_distributions(_und(spark, d), 3), 9, "value")


