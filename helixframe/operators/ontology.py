"""Term ontologies: closure, information content, semantic similarity, elimination tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from helixframe.functions.columns import with_fdr
from helixframe.functions.special import hypergeom_col
from helixframe.operators.enrichment import gsea
from helixframe.plans.checkpoint import cut


def ancestors(edges: DataFrame, most: int = 100) -> DataFrame:
    """(term, ancestor) closure of edges(parent, child), each term its own ancestor; a cycle raises."""
    one = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct()
    every = cut(edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct().withColumn("ancestor", F.col("term")).union(one))
    front = one
    for _ in range(most):
        up = one.select(F.col("term").alias("via"), F.col("ancestor").alias("next"))
        front = cut(front.join(up, front.ancestor == up.via).select("term", F.col("next").alias("ancestor")).distinct())
        if front.isEmpty():
            return every
        if not front.where("term = ancestor").isEmpty():
            raise ValueError("the ontology has a cycle")
        front = front.join(every, ["term", "ancestor"], "left_anti")
        every = cut(every.union(front))
    raise ValueError("the ontology is too deep")


def levels(edges: DataFrame) -> DataFrame:
    """term, level: longest way from a root."""
    nodes = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    roots = nodes.join(edges.select(F.col("child").alias("term")), "term", "left_anti").withColumn("level", F.lit(0))
    out = front = cut(roots)
    step = 0
    while True:
        step += 1
        front = cut(edges.join(front.select(F.col("term").alias("parent")), "parent").select(F.col("child").alias("term")).distinct().withColumn("level", F.lit(step)))
        if front.isEmpty():
            return out.groupBy("term").agg(F.max("level").alias("level"))
        out = out.union(front)


def information_content(term_genes: DataFrame) -> DataFrame:
    """term, ic = -ln(share of all genes that the term has)."""
    total = term_genes.agg(F.countDistinct("gene").alias("n"))
    return term_genes.groupBy("term").agg(F.countDistinct("gene").alias("k")).crossJoin(F.broadcast(total)).select("term", (-F.ln(F.col("k") / F.col("n"))).alias("ic"))


KINDS = ("resnik", "lin", "combined")


def similarity(pairs: DataFrame, closure: DataFrame, ic: DataFrame, kind: str = "lin") -> DataFrame:
    """term_a, term_b, value: by the common ancestor of most information (0 without one)."""
    kind = kind.lower()
    if kind not in KINDS:
        raise ValueError("unknown similarity")
    known = closure.join(ic.withColumnRenamed("term", "ancestor"), "ancestor")
    a = pairs.join(known.select(F.col("term").alias("term_a"), "ancestor", "ic"), "term_a")
    b = closure.select(F.col("term").alias("term_b"), "ancestor")
    mica = a.join(b, ["term_b", "ancestor"]).groupBy("term_a", "term_b").agg(F.max("ic").alias("mica"))
    top = ic.agg(F.max("ic").alias("top"))
    ia, ib = ic.select(F.col("term").alias("term_a"), F.col("ic").alias("ia")), ic.select(F.col("term").alias("term_b"), F.col("ic").alias("ib"))
    j = pairs.join(mica, ["term_a", "term_b"], "left").na.fill(0.0, ["mica"]).join(ia, "term_a", "left").join(ib, "term_b", "left").na.fill(1.0, ["ia", "ib"]).crossJoin(F.broadcast(top))
    resnik = F.coalesce(F.try_divide(F.col("mica"), F.col("top")), F.lit(0.0))
    lin = F.coalesce(F.try_divide(2 * F.col("mica"), F.col("ia") + F.col("ib")), F.lit(0.0))
    value = {"resnik": resnik, "lin": lin, "combined": (resnik + lin) / 2}[kind]
    return j.select("term_a", "term_b", value.alias("value"))


def s_values(edges: DataFrame, most: int = 100) -> DataFrame:
    """term, ancestor, s: the best product of edge weights from the term up; 1 for the term itself."""
    nodes = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    out = front = cut(nodes.select("term", F.col("term").alias("ancestor"), F.lit(1.0).alias("s")))
    up = edges.select(F.col("child").alias("ancestor"), "parent", "w")
    for _ in range(most):
        front = cut(front.join(up, "ancestor").groupBy("term", F.col("parent").alias("ancestor")).agg(F.max(F.col("s") * F.col("w")).alias("s")))
        if front.isEmpty():
            break
        out = out.union(front)
    else:
        raise ValueError("the ontology has a cycle or is too deep")
    return out.groupBy("term", "ancestor").agg(F.max("s").alias("s"))


def wang(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """term_a, term_b, value: shared s-values over all s-values; of all pairs a < b with a common ancestor by default."""
    s = cut(s_values(edges))
    total = s.groupBy("term").agg(F.sum("s").alias("t"))
    a, b = s.select(F.col("term").alias("term_a"), "ancestor", F.col("s").alias("sa")), s.select(F.col("term").alias("term_b"), "ancestor", F.col("s").alias("sb"))
    both = a.join(b, "ancestor").where("term_a < term_b") if pairs is None else pairs.join(a, "term_a").join(b, ["term_b", "ancestor"])
    shared = both.groupBy("term_a", "term_b").agg(F.sum(F.col("sa") + F.col("sb")).alias("x"))
    ta, tb = total.select(F.col("term").alias("term_a"), F.col("t").alias("ta")), total.select(F.col("term").alias("term_b"), F.col("t").alias("tb"))
    return shared.join(ta, "term_a").join(tb, "term_b").select("term_a", "term_b", F.when(F.col("term_a") == F.col("term_b"), 1.0).otherwise(F.col("x") / (F.col("ta") + F.col("tb"))).alias("value"))


def filter_similar(sim: DataFrame, least: float) -> DataFrame:
    return sim.where(F.col("value") >= least)


def elimination(term_genes: DataFrame, closure: DataFrame, term_levels: DataFrame, target: DataFrame, min_genes: int = 5, threshold: float = 0.01, min_overlap: int | None = None, fdr: float | None = None) -> DataFrame:
    """term, level, hits, size, p, fdr: hypergeometric tests from the deepest level up.

    The genes of a term with p of threshold or less are taken from its ancestors before those are tested. A single hit
    counts as none (p = 1), as in over_representation.
    """
    universe = term_genes.select("gene").distinct()
    n = universe.count()
    inside = cut(target.select("gene").join(universe, "gene", "left_semi").distinct())
    k = inside.count()
    genes = cut(term_genes.select("term", "gene").distinct())
    out = None
    for level in [r.level for r in term_levels.select("level").distinct().orderBy(F.desc("level")).collect()]:
        terms = term_levels.where(F.col("level") == level).select("term")
        now = genes.join(terms, "term")
        hit = now.join(inside.withColumn("hit", F.lit(1)), "gene", "left").groupBy("term").agg(F.count("*").alias("size"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits")).where(F.col("size") >= min_genes)
        q = F.greatest(F.col("hits") - 1, F.lit(0))
        res = cut(hit.withColumn("level", F.lit(level)).withColumn("p", hypergeom_col(q, F.col("size"), F.lit(n) - F.col("size"), F.lit(k))))
        out = res if out is None else out.unionByName(res)
        strong = res.where(F.col("p") <= threshold).select("term")
        if not strong.isEmpty():
            gone = now.join(strong, "term").join(closure.where("term != ancestor"), "term").select(F.col("ancestor").alias("term"), "gene").distinct()
            genes = cut(genes.join(gone, ["term", "gene"], "left_anti"))
    out = with_fdr(out, "p")
    if min_overlap is not None:
        out = out.where(F.col("hits") >= min_overlap)
    return out if fdr is None else out.where(F.col("fdr") <= fdr)


def elimination_gsea(stats: DataFrame, term_genes: DataFrame, closure: DataFrame, term_levels: DataFrame, permutations: int = 1000, least: int = 5, most: int = 500, threshold: float = 0.05, seed: int = 42) -> DataFrame:
    """term, level, size, es, nes, p, fdr: running-sum tests from the deepest level up, with the same elimination.

    The random sets of one seed serve all levels, so sizes are compared with the same nulls throughout.
    """
    genes = cut(term_genes.select("term", "gene").distinct().join(stats.select("gene"), "gene", "left_semi"))
    out = None
    for level in [r.level for r in term_levels.select("level").distinct().orderBy(F.desc("level")).collect()]:
        now = genes.join(term_levels.where(F.col("level") == level).select("term"), "term")
        res = gsea(stats, now.select(F.col("term").alias("set_id"), "gene"), permutations, least=least, most=most, seed=seed)
        res = cut(res.select(F.col("set_id").alias("term"), F.lit(level).alias("level"), "size", "es", "nes", "p"))
        out = res if out is None else out.unionByName(res)
        strong = res.where(F.col("p") <= threshold).select("term")
        if not strong.isEmpty():
            gone = now.join(strong, "term").join(closure.where("term != ancestor"), "term").select(F.col("ancestor").alias("term"), "gene").distinct()
            genes = cut(genes.join(gone, ["term", "gene"], "left_anti"))
    return with_fdr(out, "p")


def term_sizes(term_genes: DataFrame) -> DataFrame:
    return term_genes.select("term", F.count("*").over(Window.partitionBy("term")).alias("size")).distinct()
