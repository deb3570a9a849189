"""Cell-by-gene counts: quality control, normalisation, variable genes, ranks, tests, set scores, pseudo-bulk.

Tables are long: counts(cell, gene, raw). A missing entry is a zero and every mean, variance, rank and share counts it;
the closed forms below add the n - nnz zeros without a grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.functions.columns import average_rank, log_norm, with_fdr
from helixframe.functions.special import z_pvalue_col
from helixframe.operators.loess import Loess
from helixframe.plans.checkpoint import cut
from helixframe.plans.ids import dense_ids


def quality_filter(counts: DataFrame, min_cells: int = 10, min_genes: int = 100, min_library: int = 250) -> DataFrame:
    """Genes seen in min_cells cells, then cells with enough genes and counts over those genes."""
    genes = counts.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).select("gene")
    kept = counts.join(genes, "gene", "left_semi")
    good = kept.groupBy("cell").agg(F.count("*").alias("nnz"), F.sum("raw").alias("lib")).where((F.col("nnz") >= min_genes) & (F.col("lib") >= min_library)).select("cell")
    return kept.join(good, "cell", "left_semi")


def cell_summary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell").agg(F.count("*").alias("nnz"), F.sum("raw").cast("long").alias("lib_size"))


def gene_summary(norm: DataFrame) -> DataFrame:
    """nnz and the sum of normalised values per gene."""
    return norm.groupBy("gene").agg(F.count("*").alias("nnz"), F.sum("norm").alias("sum_norm"))


def normalise(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Adds norm = ln(1 + raw / library * target)."""
    library = F.sum("raw").over(Window.partitionBy("cell"))
    return counts.withColumn("norm", log_norm(F.col("raw"), library, target))


def reindexed(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts with dense ids (cell, gene), order kept, and both maps (old, new)."""
    maps = []
    for key in ("cell", "gene"):
        maps.append(dense_ids(counts.select(F.col(key).alias("old")).distinct(), ["old"], "new"))
    out = counts
    for key, ids in zip(("cell", "gene"), maps, strict=True):
        out = out.join(ids, out[key] == ids["old"]).drop(key, "old").withColumnRenamed("new", key)
    return out.select("cell", "gene", "raw"), *maps


def top_gene_share(counts: DataFrame, tops: Sequence[int]) -> DataFrame:
    """cell, top, share: of a cell's counts in its most frequent genes; exactly 1 with no more genes than that."""
    w = Window.partitionBy("cell")
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("raw"), "gene")))
    sums = ranked.groupBy("cell").agg(F.sum("raw").alias("lib"), *[F.sum(F.when(F.col("rank") <= t, F.col("raw"))).alias(f"t{t}") for t in tops])
    return sums.select("cell", F.explode(F.array(*[F.struct(F.lit(t).alias("top"), (F.col(f"t{t}") / F.col("lib")).alias("share")) for t in tops])).alias("x")).select("cell", "x.*")


def gene_set_share(counts: DataFrame, sets: DataFrame) -> DataFrame:
    """cell, set_id, share: of a cell's counts in each gene set; pairs without any count are absent."""
    lib = counts.groupBy("cell").agg(F.sum("raw").alias("lib"))
    inside = counts.join(sets, "gene").groupBy("cell", "set_id").agg(F.sum("raw").alias("s"))
    return inside.join(lib, "cell").select("cell", "set_id", (F.col("s") / F.col("lib")).alias("share"))


def grouped_gene_stats(norm: DataFrame, groups: DataFrame) -> DataFrame:
    """gene, grp, mean (zeros counted) and share of expressing cells; groups(cell, grp)."""
    size = groups.groupBy("grp").agg(F.count("*").alias("size"))
    seen = norm.join(groups, "cell").groupBy("gene", "grp").agg(F.sum("norm").alias("s"), F.count("*").alias("n"))
    return seen.join(size, "grp").select("gene", "grp", (F.col("s") / F.col("size")).alias("mean"), (F.col("n") / F.col("size")).alias("share"))


def gene_vector(norm: DataFrame, cells: DataFrame, gene: int, scale: bool = False, clip: float | None = None) -> DataFrame:
    """cell, raw, norm of one gene over the given cells, zeros filled; scaled by the population sd, clipped."""
    one = norm.where(F.col("gene") == gene).select("cell", "raw", "norm")
    out = cells.select("cell").join(one, "cell", "left").select("cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("norm", F.lit(0.0)).alias("norm"))
    if scale:
        s = out.agg(F.avg("norm").alias("m"), F.stddev_pop("norm").alias("sd"))
        out = out.crossJoin(F.broadcast(s)).select("cell", "raw", F.when(F.col("sd") > 1e-8, (F.col("norm") - F.col("m")) / F.col("sd")).otherwise(F.col("norm")).alias("norm"))
    if clip is not None:
        out = out.withColumn("norm", F.greatest(F.least("norm", F.lit(clip)), F.lit(-clip)))
    return out


def pseudo_bulk(norm: DataFrame, groups: DataFrame, kind: str = "raw") -> DataFrame:
    """grp, gene, value: sum of raw counts, or mean of normalised ones over all cells of a group; groups may overlap."""
    kind = {"raw": "raw", "norm": "norm", "normalised": "norm", "normalized": "norm"}.get(kind.lower())
    if kind is None:
        raise ValueError("unknown kind")
    joined = norm.join(groups, "cell")
    if kind == "raw":
        return joined.groupBy("grp", "gene").agg(F.sum("raw").cast("double").alias("value"))
    size = groups.groupBy("grp").agg(F.count("*").alias("size"))
    return joined.groupBy("grp", "gene").agg(F.sum("norm").alias("s")).join(size, "grp").select("grp", "gene", (F.col("s") / F.col("size")).alias("value"))


def aggregate_metacells(counts: DataFrame, members: DataFrame, target: float = 1e4) -> DataFrame:
    """metacell, gene, raw, norm of summed cells; members(metacell, cell)."""
    raw = counts.join(members, "cell").groupBy("metacell", "gene").agg(F.sum("raw").cast("long").alias("raw"))
    return raw.withColumn("norm", log_norm(F.col("raw"), F.sum("raw").over(Window.partitionBy("metacell")), target))


def assignments(cells: DataFrame, members: DataFrame) -> DataFrame:
    """cell, metacell: null without one, the last of several."""
    return cells.select("cell").join(members.groupBy("cell").agg(F.max("metacell").alias("metacell")), "cell", "left")


def mean_variance(counts: DataFrame, n_cells: int, by: Sequence[str] = ()) -> DataFrame:
    """Population mean and variance of raw counts per gene, zeros included."""
    s = counts.groupBy(*by, "gene").agg(F.sum("raw").alias("s"), F.sum(F.col("raw").cast("double") * F.col("raw")).alias("q"))
    n = F.lit(float(n_cells))
    mean = F.col("s") / n
    return s.select(*by, "gene", mean.alias("mean"), (F.col("q") / n - mean * mean).alias("var"))


def variable_genes(counts: DataFrame, n_cells: int, span: float = 0.3, clip: float | None = None, method: str = "vst", most: int | None = None) -> DataFrame:
    """gene, mean, var, expected, var_std: variance of standardised counts clipped at sqrt(n), after a LOESS fit in logs.

    All genes of a window enter its fit; most: the nearest of them only.
    """
    if method.lower() != "vst":
        raise NotImplementedError(f"{method} is not available")
    sized = counts.select("gene", "raw", F.lit(float(n_cells)).alias("n"))
    return _variable(sized, (), span, clip, most)


def variable_genes_by_batch(counts: DataFrame, cells: DataFrame, span: float = 0.3) -> DataFrame:
    """variable_genes within each batch of cells(cell, batch); a fit for each batch, side by side."""
    size = cells.groupBy("batch").agg(F.count("*").cast("double").alias("n"))
    sized = counts.join(cells.select("cell", "batch"), "cell").join(size, "batch").select("batch", "gene", "raw", "n")
    return _variable(sized, ("batch",), span, None)


def _variable(counts: DataFrame, by: Sequence[str], span: float, clip: float | None, most: int | None = None) -> DataFrame:
    """by, gene, mean, var, expected, var_std of counts(by, gene, raw, n); n: cells, those without counts included."""
    raw = F.col("raw").cast("double")
    s = counts.groupBy(*by, "gene", "n").agg(F.sum("raw").alias("s"), F.sum(raw * raw).alias("q"))
    mean = F.col("s") / F.col("n")
    mv = s.select(*by, "gene", "n", mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("var")).where("var > 0")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene")  # genes of one mean in a fixed order
        fitted = Loess(span, 2, most).fit(np.log10(pdf["mean"].to_numpy()), np.log10(pdf["var"].to_numpy())).fitted
        return pdf.assign(expected=10.0**fitted)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mv.schema.fields)
    names = mv.columns
    # genes of a batch: a gene-sized input
    expected = mv.groupBy(*(by or [F.lit(0).alias("one")])).applyInPandas(lambda pdf: fit(pdf[names]), f"{kinds}, expected double")
    limit = F.sqrt("n") if clip is None else F.lit(float(clip))
    sd = F.sqrt("expected")
    z = F.greatest(F.least((F.col("raw") - F.col("mean")) / sd, limit), -limit)
    z0 = F.greatest(F.least(-F.col("mean") / sd, limit), -limit)
    j = counts.drop("n").join(expected, [*by, "gene"]).groupBy(*by, "gene", "n", "mean", "var", "expected").agg(F.sum(z).alias("sz"), F.sum(z * z).alias("qz"), F.count("*").alias("nnz"))
    zeros = F.col("n") - F.col("nnz")
    m = (F.col("sz") + zeros * z0) / F.col("n")
    return j.select(*by, "gene", "mean", "var", "expected", ((F.col("qz") + zeros * z0 * z0) / F.col("n") - m * m).alias("var_std"))


def select_variable(hvg: DataFrame, percentile: float = 0.85) -> DataFrame:
    """The ceil(n (1 - percentile)) genes of largest var_std."""
    n = F.count("*").over(Window.partitionBy())
    r = F.row_number().over(Window.orderBy(F.desc("var_std"), "gene"))
    return hvg.withColumn("r", r).withColumn("n", n).where(F.col("r") <= F.ceil(F.col("n") * F.round(F.lit(1 - percentile), 9))).select("gene")


def ranks_within(values: DataFrame, key: str, other_count: int, value: str = "norm") -> DataFrame:
    """Average ranks of non-negative values within key with implicit zeros: those rank (1 + n0) / 2, the rest is shifted."""
    n0 = F.lit(other_count) - F.count("*").over(Window.partitionBy(key))
    return values.withColumn("rank", average_rank(value, [key]) + n0).withColumn("zero_rank", (1 + n0) / 2)


def dge(norm: DataFrame, group_1: DataFrame, group_2: DataFrame, min_share: float = 0.05, alternative: str = "twosided") -> DataFrame:
    """gene, share_1, share_2, lfc, z, p, fdr: Mann-Whitney per gene without tie or continuity correction.

    Zeros take part through their count: n0 of them hold the mean rank (1 + n0) / 2 and shift the others by n0.
    """
    n1, n2 = group_1.count(), group_2.count()
    both = group_1.select("cell", F.lit(1).alias("g")).union(group_2.select("cell", F.lit(2)))
    x = norm.join(both, "cell")
    n0 = F.lit(n1 + n2) - F.count("*").over(Window.partitionBy("gene"))
    x = x.withColumn("rank", average_rank("norm", ["gene"]) + n0).withColumn("n0", n0)
    one = F.col("g") == 1
    s = x.groupBy("gene").agg(
        F.sum(one.cast("long")).alias("k1"), F.sum((~one).cast("long")).alias("k2"), F.sum(F.when(one, F.col("norm")).otherwise(0.0)).alias("s1"), F.sum(F.when(one, 0.0).otherwise(F.col("norm"))).alias("s2"), F.sum(F.when(one, F.col("rank")).otherwise(0.0)).alias("r1"), F.first("n0").alias("n0")
    )
    a, b = F.lit(float(max(n1, 1))), F.lit(float(max(n2, 1)))
    rank_sum = F.col("r1") + (F.lit(n1) - F.col("k1")) * (1 + F.col("n0")) / 2
    u1 = rank_sum - n1 * (n1 + 1) / 2
    sd = float(np.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)) if n1 and n2 else 1.0
    z = (u1 - n1 * n2 / 2) / sd if n1 and n2 else F.lit(0.0)
    out = s.select("gene", (F.col("k1") / a).alias("share_1"), (F.col("k2") / b).alias("share_2"), (F.col("s1") / a - F.col("s2") / b).alias("lfc"), z.alias("z"))
    out = out.where((F.col("share_1") >= min_share) | (F.col("share_2") >= min_share)).withColumn("p", z_pvalue_col(F.col("z"), alternative))
    return with_fdr(out, "p")


def set_activity(norm: DataFrame, sets: DataFrame, n_genes: int, kind: str = "wilcox") -> DataFrame:
    """cell, set_id, auc: of a set's genes among a cell's ranks; kind wilcox or auroc."""
    kind = kind.lower()
    if kind not in ("wilcox", "auroc"):
        raise ValueError("unknown kind")
    size = sets.groupBy("set_id").agg(F.count("*").alias("m"))
    ranked = ranks_within(norm, "cell", n_genes)
    about = ranked.groupBy("cell").agg(F.first("zero_rank").alias("zero_rank"))
    seen = ranked.join(sets, "gene")
    big = F.lit(float(n_genes))
    m = F.col("m")
    if kind == "wilcox":
        sums = seen.groupBy("cell", "set_id").agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
        grid = about.crossJoin(F.broadcast(size)).join(sums, ["cell", "set_id"], "left").na.fill(0, ["r", "k"])
        total = F.col("r") + (m - F.col("k")) * F.col("zero_rank")
        return grid.select("cell", "set_id", ((total - m * (m + 1) / 2) / (m * (big - m))).alias("auc"))
    # the missing genes of a set come first, all at the rank of zeros
    place = seen.withColumn("i", F.row_number().over(Window.partitionBy("cell", "set_id").orderBy("rank")))
    sums = place.groupBy("cell", "set_id").agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    grid = about.crossJoin(F.broadcast(size)).join(sums, ["cell", "set_id"], "left").na.fill(0, ["r", "k"])
    total = F.col("r") + (m - F.col("k")) * F.col("zero_rank") - (m + 1) / 2 * big
    return grid.select("cell", "set_id", (total / (m * (big - m / 2))).alias("auc"))


def expression_bins(means: DataFrame, bins: int = 24) -> DataFrame:
    """gene, bin by rank of the mean; gene ids break ties."""
    n = F.count("*").over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy("mean", "gene")) - 1
    return means.select("gene", F.least(F.floor(i / F.ceil(n / bins)), F.lit(bins - 1)).cast("int").alias("bin"))


def control_genes(sets: DataFrame, bins: DataFrame, controls: int = 100, seed: int = 42) -> DataFrame:
    """set_id, gene: for each gene of a set, ``controls`` different genes of its bin, seeded by the gene; union.

    Places in the bin are drawn and joined, so a gene meets the genes drawn for it and not its whole bin.
    """
    kind = bins.schema["gene"].dataType.simpleString()
    placed = bins.select("bin", "gene", (F.row_number().over(Window.partitionBy("bin").orderBy(F.xxhash64("gene", F.lit(seed)), "gene")) - 1).cast("long").alias("place"))
    size = bins.groupBy("bin").agg(F.count("*").alias("size"))
    of = sets.select("gene").distinct().join(bins, "gene").join(F.broadcast(size), "bin").select("gene", "bin", "size", F.xxhash64("gene", F.lit(seed)).alias("h"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own = [np.random.default_rng([h & (2**64 - 1), seed]).choice(n, min(n, controls), replace=False) for h, n in zip(pdf["h"].tolist(), pdf["size"].tolist(), strict=True)]
                yield pdf[["gene", "bin"]].assign(places=own)

    # few rows and much work: partitions that sizes alone would merge
    of = of.repartition(4 * sets.sparkSession.sparkContext.defaultParallelism, "gene")
    drawn = of.mapInPandas(draw, f"gene {kind}, bin int, places array<long>").select(F.col("gene").alias("for"), "bin", F.explode("places").alias("place"))
    found = drawn.join(placed, ["bin", "place"]).select("for", "gene")
    return sets.select("set_id", F.col("gene").alias("for")).join(found, "for").select("set_id", "gene").distinct()


def module_scores(norm: DataFrame, sets: DataFrame, controls: DataFrame) -> DataFrame:
    """cell, set_id, score: mean over the set minus mean over its controls, zeros counted."""
    kinds = cut(sets.select("set_id", "gene", F.lit(True).alias("x")).union(controls.select("set_id", "gene", F.lit(False))))
    size = cut(kinds.groupBy("set_id").agg(F.sum(F.col("x").cast("int")).alias("a"), F.sum((~F.col("x")).cast("int")).alias("b")))
    number = F.broadcast(cut(dense_ids(size.select("set_id"), ["set_id"], "n")))
    # a count goes once to its cell, with the numbers of its gene's sets; it is told apart by sets only there
    code = (2 * F.col("n") + F.col("x").cast("int")).cast("int")
    lists = kinds.join(number, "set_id").groupBy("gene").agg(F.collect_list(code).alias("in"))
    met = norm.select("cell", "gene", "norm").join(lists, "gene").select("cell", "norm", "in").repartition("cell")
    s = met.select("cell", "norm", F.explode("in").alias("c")).withColumn("n", F.shiftright("c", 1).cast("long")).withColumn("x", F.col("c") % 2 == 1)
    s = s.groupBy("cell", "n").agg(F.sum(F.when(F.col("x"), F.col("norm")).otherwise(0.0)).alias("sa"), F.sum(F.when(F.col("x"), 0.0).otherwise(F.col("norm"))).alias("sb"))
    about = F.broadcast(size.join(number, "set_id"))
    return s.join(about, "n").select("cell", "set_id", (F.col("sa") / F.greatest("a", F.lit(1)) - F.col("sb") / F.greatest("b", F.lit(1))).alias("score"))


def signature_scores(norm: DataFrame, signatures: DataFrame, n_genes: int) -> DataFrame:
    """cell, set_id, score: signed mean of signature genes (set_id, gene, sign), standardised by all genes of the cell."""
    n = F.lit(float(n_genes))
    about = norm.groupBy("cell").agg((F.sum("norm") / n).alias("mu"), F.sqrt(F.greatest(F.sum(F.col("norm") * F.col("norm")) / n - F.pow(F.sum("norm") / n, 2), F.lit(0.0))).alias("sd"))
    size = signatures.groupBy("set_id").agg(F.count("*").alias("m"))
    s = norm.join(signatures, "gene").groupBy("cell", "set_id").agg(F.sum(F.col("norm") * F.col("sign")).alias("s"))
    grid = about.crossJoin(F.broadcast(size)).join(s, ["cell", "set_id"], "left").na.fill(0.0, ["s"])
    return grid.select("cell", "set_id", F.when(F.col("sd") > 0, F.try_divide(F.col("s") / F.col("m") - F.col("mu"), F.col("sd"))).otherwise(0.0).alias("score"))


def gene_correlations(norm: DataFrame, pairs: DataFrame, n_cells: int) -> DataFrame:
    """gene_a, gene_b, value: Pearson over all cells from sums alone, zeros included; constant genes give 0."""
    n = F.lit(float(n_cells))
    s = norm.groupBy("gene").agg(F.sum("norm").alias("s"), F.sum(F.col("norm") * F.col("norm")).alias("q"))
    x = norm.select("cell", F.col("gene").alias("gene_a"), F.col("norm").alias("x"))
    y = norm.select("cell", F.col("gene").alias("gene_b"), F.col("norm").alias("y"))
    xy = x.join(pairs, "gene_a").join(y, ["cell", "gene_b"]).groupBy("gene_a", "gene_b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    sa, sb = s.select(F.col("gene").alias("gene_a"), F.col("s").alias("sa"), F.col("q").alias("qa")), s.select(F.col("gene").alias("gene_b"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    j = pairs.join(xy, ["gene_a", "gene_b"], "left").na.fill(0.0, ["xy"]).join(sa, "gene_a").join(sb, "gene_b")
    va, vb = F.col("qa") - F.col("sa") * F.col("sa") / n, F.col("qb") - F.col("sb") * F.col("sb") / n
    r = F.try_divide(F.col("xy") - F.col("sa") * F.col("sb") / n, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))
    return j.select("gene_a", "gene_b", F.greatest(F.least(F.coalesce(r, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)).alias("value"))


def expressed_genes(counts: DataFrame, n_cells: int, least_counts: int = 50, least_share: float = 0.03) -> DataFrame:
    return counts.groupBy("gene").agg(F.sum("raw").alias("s"), F.count("*").alias("n")).where((F.col("s") >= least_counts) & (F.col("n") / n_cells >= least_share)).select("gene")


