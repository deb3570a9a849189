"""Gene-set enrichment: over-representation, running-sum statistics with simple and multilevel p-values, set variation,
multi-contrast tests, motif recovery."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.functions.columns import average_rank, with_fdr
from helixframe.functions.special import beta_quantile, digamma, f_sf, hypergeom_col, normal_cdf, poisson_cdf, trigamma


def over_representation(sets: DataFrame, target: DataFrame, universe: DataFrame, min_overlap: int | None = None, fdr: float | None = None) -> DataFrame:
    """set_id, hits, size, p, fdr, odds. P(X > hits - 1); with no more than one hit p is 1. The odds ratio may be infinite."""
    n, k = universe.select("gene").distinct().count(), target.select("gene").distinct().count()
    flag = target.select("gene", F.lit(1).alias("hit")).distinct()
    s = sets.select("set_id", "gene").distinct().join(flag, "gene", "left").groupBy("set_id").agg(F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("hits"), F.count("*").alias("size"))
    a, b, c = F.col("hits"), F.lit(k) - F.col("hits"), F.col("size") - F.col("hits")
    d = F.lit(n) - F.col("size") - F.lit(k) + F.col("hits")
    odds = F.when((b * c) == 0, F.when((a * d) == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide((a * d).cast("double"), (b * c).cast("double")))
    out = s.withColumn("odds", odds).withColumn("p", hypergeom_col(F.greatest(a - 1, F.lit(0)), F.col("size"), F.lit(n) - F.col("size"), F.lit(k)))
    out = with_fdr(out, "p")
    if min_overlap is not None:
        out = out.where(F.col("hits") >= min_overlap)
    return out if fdr is None else out.where(F.col("fdr") <= fdr)


def ranked(stats: DataFrame) -> DataFrame:
    """gene, stat, pos: 1-based places of the statistic, largest first; gene ids break ties."""
    return stats.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("stat"), "gene")))


def enrichment_scores(stats: DataFrame, sets: DataFrame, power: float = 1.0, least: int = 1, most: int | None = None, leading_edge: bool = False) -> DataFrame:
    """set_id, size, es: the larger deviation of the running sum, 0 on a tie; a set of zero statistics weighs alike.

    The sum changes by hits only, so it is read off at each hit (top) and just before it (bottom): no walk over all genes.
    The leading edge is cut at the extreme of the bottoms.
    """
    place = ranked(stats)
    n = stats.count()
    hit = sets.select("set_id", "gene").distinct().join(place, "gene").withColumn("size", F.count("*").over(Window.partitionBy("set_id")))
    hit = hit.where(F.col("size") >= least) if most is None else hit.where(F.col("size").between(least, most))
    w = Window.partitionBy("set_id").orderBy("pos")
    weight = F.pow(F.abs("stat"), F.lit(float(power)))
    hit = hit.withColumn("x", weight).withColumn("nr", F.sum("x").over(Window.partitionBy("set_id")))
    hit = hit.withColumn("x", F.when(F.col("nr") == 0, 1 / F.col("size")).otherwise(F.try_divide("x", "nr")))
    # with zero statistics the sum starts a step lower
    hit = hit.withColumn("i", F.row_number().over(w)).withColumn("cum", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("nr") == 0, F.col("x")).otherwise(0.0))
    miss = F.try_divide(F.col("pos") - F.col("i"), F.lit(n) - F.col("size"))
    hit = hit.withColumn("top", F.col("cum") - F.coalesce(miss, F.lit(0.0))).withColumn("bottom", F.col("top") - F.col("x"))
    hi, lo = F.max("top"), F.min("bottom")
    cols = [F.first("size").cast("long").alias("size"), F.when(hi > -lo, hi).when(hi < -lo, lo).otherwise(0.0).alias("es"), F.max_by("pos", "bottom").alias("up"), F.min_by("pos", "bottom").alias("down")]
    es = hit.groupBy("set_id").agg(*cols)
    if not leading_edge:
        return es.select("set_id", "size", "es")
    edge = hit.join(es.select("set_id", "es", "up", "down"), "set_id").where(F.when(F.col("es") > 0, F.col("pos") <= F.col("up")).when(F.col("es") < 0, F.col("pos") >= F.col("down")).otherwise(False))
    genes = edge.groupBy("set_id").agg(F.array_sort(F.collect_list("gene")).alias("leading_edge"))
    return es.select("set_id", "size", "es").join(genes, "set_id", "left")


def prefix_scores(weights: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Enrichment score of every prefix of a random gene sequence; weights are |stat|^p in rank order."""
    n, out = len(weights), np.zeros(len(drawn))
    for k in range(1, len(drawn) + 1):
        pos = np.sort(drawn[:k])
        x = weights[pos]
        total = x.sum()
        x = x / total if total else np.full(k, 1 / k)
        top = np.cumsum(x) - (pos - np.arange(k)) / max(n - k, 1)
        hi, lo = top.max(), (top - x).min()
        out[k - 1] = hi if hi > -lo else lo if hi < -lo else 0.0
    return out


def gsea(stats: DataFrame, sets: DataFrame, permutations: int = 1000, power: float = 1.0, least: int = 5, most: int = 500, seed: int = 42, per_task: int = 20) -> DataFrame:
    """set_id, size, es, nes, p, fdr, n_more_extreme: scores against random sets, one sequence giving all sizes at once.

    Only the sizes that occur are kept per permutation, as counts per task; sequences are seeded by their number.
    """
    spark = stats.sparkSession
    es = enrichment_scores(stats, sets, power, least, most).cache()
    scores = {}
    for r in es.collect():  # one row a set
        scores.setdefault(r["size"], []).append((r.set_id, r.es))
    if not scores:
        return es.select("set_id", "size", "es", *[F.lit(None).cast("double").alias(c) for c in ("nes", "p", "fdr")], F.lit(None).cast("long").alias("n_more_extreme"))
    weights = np.array([abs(r.stat) ** power for r in ranked(stats).orderBy("pos").select("stat").collect()])
    sizes, shared = sorted(scores), spark.sparkContext.broadcast(weights)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rng = np.random.default_rng(seed + int(i))
                drawn = rng.permutation(len(shared.value) - 1)[: max(sizes)]  # the last gene is never drawn
                e = prefix_scores(shared.value, drawn)
                rows += [(k, float(e[min(k, len(e)) - 1])) for k in sizes]
            yield pd.DataFrame(rows, columns=["size", "null"])

    null = spark.range(0, permutations, 1, max(1, permutations // per_task)).mapInPandas(draw, "size long, null double")
    j = es.join(null, "size").groupBy("set_id", "size", "es").agg(
        F.sum((F.col("null") <= F.col("es")).cast("long")).alias("le"), F.sum((F.col("null") >= F.col("es")).cast("long")).alias("ge"), F.sum((F.col("null") <= 0).cast("long")).alias("le0"), F.sum((F.col("null") >= 0).cast("long")).alias("ge0"),
        F.sum(F.least("null", F.lit(0.0))).alias("neg"), F.sum(F.greatest("null", F.lit(0.0))).alias("pos"))
    mean = F.when(F.col("es") > 0, F.try_divide("pos", "ge0")).otherwise(F.abs(F.try_divide("neg", "le0")))
    p = F.least((1 + F.col("le")) / (1 + F.col("le0")), (1 + F.col("ge")) / (1 + F.col("ge0")))
    out = j.withColumn("nes", F.when(mean != 0, F.try_divide(F.col("es"), mean))).withColumn("p", p).withColumn("n_more_extreme", F.when(F.col("es") > 0, F.col("ge")).otherwise(F.col("le")))
    return with_fdr(out, "p").select("set_id", "size", "es", "nes", "p", "fdr", "n_more_extreme")


def _positive(weights: np.ndarray, pos: np.ndarray) -> float:
    x = weights[pos]
    total = x.sum()
    x = x / total if total else np.full(len(pos), 1 / len(pos))
    return float((np.cumsum(x) - (pos - np.arange(len(pos))) / max(len(weights) - len(pos), 1)).max())


def multilevel_p(es: float, weights: np.ndarray, size: int, samples: int = 101, seed: int = 42, eps: float = 1e-50) -> tuple[float, bool]:
    """Adaptive multilevel splitting p-value of one score; the flag says whether eps was reached."""
    w = weights[::-1] if es < 0 else weights
    goal, n, rng = abs(es), len(weights), np.random.default_rng(seed)
    sets = [np.sort(rng.choice(n, size, replace=False)) for _ in range(samples)]
    score = np.array([_positive(w, s) for s in sets])
    half, levels = (samples + 1) // 2, 0
    step = digamma(half) - digamma(samples + 1)
    while True:
        order = np.argsort(score, kind="stable")
        level = score[order[half - 1]]
        if level >= goal or levels * step < math.log(eps):
            break
        upper = [sets[i] for i in order[half:]]
        sets = [s.copy() for s in (upper + upper)[: samples - 1]] + [sets[order[half - 1]].copy()]
        levels += 1
        moves, tries = 0, 0
        while moves < samples * size and tries < 20:
            tries += 1
            for s in range(len(sets)):
                for _ in range(max(1, size // 10)):
                    new = int(rng.integers(n))
                    if new in sets[s]:
                        continue
                    cand = sets[s].copy()
                    cand[rng.integers(size)] = new
                    cand.sort()
                    if _positive(w, cand) > level:
                        sets[s] = cand
                        moves += 1
        new_score = np.array([_positive(w, s) for s in sets])
        if np.array_equal(new_score, score):
            break
        score = new_score
    above = int((score >= goal).sum())
    p = math.exp(levels * step + digamma(above + 1) - digamma(samples + 2))
    return max(p, eps), p > eps


def gsea_multilevel(stats: DataFrame, sets: DataFrame, samples: int = 101, power: float = 1.0, least: int = 5, most: int = 500, seed: int = 42, eps: float = 1e-50) -> DataFrame:
    """set_id, size, es, p, reached, log2err, fdr; sets are spread over the tasks."""
    es = enrichment_scores(stats, sets, power, least, most)
    weights = stats.sparkSession.sparkContext.broadcast(np.array([abs(r.stat) ** power for r in ranked(stats).orderBy("pos").select("stat").collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [multilevel_p(e, weights.value, int(k), samples, seed, eps) for e, k in zip(pdf["es"], pdf["size"], strict=True)]
            yield pdf.assign(p=[g[0] for g in got], reached=[g[1] for g in got], log2err=[multilevel_error(g[0], samples) for g in got])

    parts = max(1, min(64, es.count()))
    return with_fdr(es.repartition(parts, "set_id").mapInPandas(run, "set_id string, size long, es double, p double, reached boolean, log2err double"), "p")


def multilevel_error(p: float, samples: int) -> float:
    return math.sqrt(math.floor(-math.log2(p) + 1) * (trigamma((samples + 1) / 2) - trigamma(samples + 1))) / math.log(2)


def simple_error(more_extreme: int, permutations: int) -> float:
    """Half-width of the log2 p-value's 95 % interval by Beta quantiles."""
    a, b = more_extreme + 1, permutations - more_extreme + 1
    return 0.5 * (math.log2(beta_quantile(0.975, a, b)) - math.log2(max(beta_quantile(0.025, a, b), 1e-300)))


#: Pairs of samples held at a time.
PAIRS = 1 << 20


def _smoothed(x: np.ndarray, gaussian: bool) -> np.ndarray:
    """The kernel-smoothed cumulative density of each value among its row's (genes x samples)."""
    if not gaussian and not (x > -0.5).all():
        raise ValueError("rates must be positive")
    out, k = np.empty_like(x), x.shape[1]
    step, across = max(1, PAIRS // k**2), max(1, min(k, PAIRS // k))
    for i in range(0, len(x), step):
        y = x[i : i + step]
        width = np.maximum(y.std(axis=1, ddof=1) / 4 if k > 1 else np.zeros(len(y)), 0.001)[:, None, None]
        for j in range(0, k, across):
            a, b = y[:, j : j + across, None], y[:, None, :]
            left = normal_cdf((a - b) / width) if gaussian else poisson_cdf(*np.broadcast_arrays(b + 0.5, np.trunc(a)))
            out[i : i + step, j : j + across] = left.mean(axis=2)
    return out


def kernel_density(expression: DataFrame, gaussian: bool = True) -> DataFrame:
    """gene, sample, value: log-odds of the kernel-smoothed cumulative density of each value among its gene's samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = pdf["value"].map(len)
            for k in size.unique():
                own = pdf[size == k]
                t = _smoothed(np.array(own["value"].tolist(), float), gaussian).ravel()
                value = -np.log((1 - t) / np.maximum(t, 1e-15)).clip(-700, 700)
                yield pd.DataFrame({"gene": own["gene"].repeat(k).to_numpy(), "sample": np.concatenate(own["sample"].tolist()), "value": value})

    kind = {c: expression.schema[c].dataType.simpleString() for c in ("gene", "sample")}
    rows = expression.groupBy("gene").agg(F.collect_list(F.struct("sample", F.col("value").cast("double").alias("value"))).alias("of"))
    return rows.select("gene", "of.sample", "of.value").mapInPandas(run, f"gene {kind['gene']}, sample {kind['sample']}, value double")


def set_variation(expression: DataFrame, sets: DataFrame, gaussian: bool = True, tau: float = 1.0, max_diff: bool = True, abs_rank: bool = False, kernel: bool = True) -> DataFrame:
    """set_id, sample, score: random walk over the ranks of kernel densities (or of the values themselves)."""
    z = kernel_density(expression, gaussian) if kernel else expression
    n = F.count("*").over(Window.partitionBy("sample"))
    order = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("value"), "gene"))
    r = z.withColumn("pos", order).withColumn("n", n).withColumn("weight", F.pow(F.abs(F.col("n") - F.col("pos") + 1 - F.col("n") / 2), F.lit(float(tau))))
    hit = r.join(sets.select("set_id", "gene").distinct(), "gene")
    by = Window.partitionBy("set_id", "sample")
    w = by.orderBy("pos")
    hit = hit.withColumn("k", F.count("*").over(by)).withColumn("total", F.sum("weight").over(by)).withColumn("i", F.row_number().over(w)).withColumn("cum", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    miss = F.coalesce(F.try_divide(F.col("pos") - F.col("i"), F.col("n") - F.col("k")), F.lit(0.0))
    top = F.coalesce(F.try_divide("cum", "total"), F.lit(0.0)) - miss
    low = F.coalesce(F.try_divide(F.col("cum") - F.col("weight"), F.col("total")), F.lit(0.0)) - miss
    best = hit.groupBy("set_id", "sample").agg(F.greatest(F.max(top), F.lit(0.0)).alias("up"), F.least(F.min(low), F.lit(0.0)).alias("down"))
    if max_diff:
        score = F.col("up") - F.col("down") if abs_rank else F.col("up") + F.col("down")
    else:
        score = F.when(F.col("up") > F.abs("down"), F.col("up")).otherwise(F.col("down"))
    return best.select("set_id", "sample", score.alias("score"))


def single_sample_scores(expression: DataFrame, sets: DataFrame, alpha: float = 0.25, normalise: bool = True) -> DataFrame:
    """set_id, sample, score: weighted minus unweighted recovery in closed form, over the range of all scores if normalised."""
    n = F.count("*").over(Window.partitionBy("sample"))
    r = expression.withColumn("rank", average_rank("value", ["sample"])).withColumn("n", n).withColumn("pos", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("value"), "gene")))
    r = r.withColumn("weight", F.pow(F.abs("rank"), F.lit(float(alpha)))).withColumn("left", F.col("n") - F.col("pos") + 1)
    every = F.col("n") * (F.col("n") + 1) / 2
    s = r.join(sets.select("set_id", "gene").distinct(), "gene").groupBy("set_id", "sample", "n").agg(F.sum(F.col("weight") * F.col("left")).alias("a"), F.sum("weight").alias("w"), F.sum("left").alias("l"), F.count("*").alias("k"))
    out = s.select("set_id", "sample", (F.try_divide("a", "w") - F.coalesce(F.try_divide(every - F.col("l"), F.col("n") - F.col("k")), F.lit(0.0))).alias("score"))
    if not normalise:
        return out
    span = out.agg((F.max("score") - F.min("score")).alias("span"))
    return out.crossJoin(F.broadcast(span)).select("set_id", "sample", F.coalesce(F.try_divide("score", "span"), F.lit(0.0)).alias("score"))


def contrast_ranks(contrasts: DataFrame) -> DataFrame:
    """gene, contrast, rank centred at the place of zero: average rank - (negatives + zeros / 2)."""
    w = Window.partitionBy("contrast")
    zero = F.sum((F.col("value") < 0).cast("double") + (F.col("value") == 0).cast("double") / 2).over(w)
    return contrasts.select("gene", "contrast", (average_rank("value", ["contrast"]) - zero).alias("rank"))


def manova(within: np.ndarray, between: np.ndarray, n: int) -> dict[str, float]:
    """Two-group tests from sums of squares and products: Wilks and Pillai with their F tests."""
    p, q, v = len(within), 1, n - 2
    both = within + between
    wilks = float(np.linalg.det(within) / np.linalg.det(both)) if np.linalg.det(both) else float("nan")
    pillai = float(np.trace(between @ np.linalg.pinv(both)))
    d1, d2 = p * q, q * (v + q - p)
    s = min(p, q)
    f = (pillai / s) / max(1 - pillai / s, 1e-300) * d2 / d1
    fw = (1 - wilks) / max(wilks, 1e-300) * (v + q - p) / p
    return {"wilks": wilks, "wilks_f": fw, "wilks_p": f_sf(fw, p, v + q - p), "pillai": pillai, "pillai_f": f, "pillai_p": f_sf(f, d1, d2)}


def multi_contrast(contrasts: DataFrame, sets: DataFrame, least: int = 5) -> DataFrame:
    """set_id, size, p, fdr, scores (2 (mean in - mean out) / n by contrast), p_contrast, distance, sd."""
    r = contrast_ranks(contrasts)
    names = [x.contrast for x in contrasts.select("contrast").distinct().orderBy("contrast").collect()]
    wide = r.groupBy("gene").pivot("contrast", names).agg(F.first("rank")).na.drop()
    cols = [f"`{c}`" for c in names]
    d = len(names)
    products = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)] + [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"q{i}_{j}") for i, j in products]
    all_ = wide.agg(F.count("*").alias("n"), *sums).first()
    inside = wide.join(sets.select("set_id", "gene").distinct(), "gene").groupBy("set_id").agg(F.count("*").alias("size"), *sums).where(F.col("size") >= least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.array([all_[f"s{i}"] for i in range(d)])
        square = np.zeros((d, d))
        for i, j in products:
            square[i, j] = square[j, i] = all_[f"q{i}_{j}"]
        n = all_["n"]
        for pdf in batches:
            rows = []
            for x in pdf.to_dict("records"):
                k, s = x["size"], np.array([x[f"s{i}"] for i in range(d)])
                if k >= n:
                    continue
                a, b, mean = s / k, (total - s) / (n - k), total / n
                between = k * np.outer(a - mean, a - mean) + (n - k) * np.outer(b - mean, b - mean)
                within = square - n * np.outer(mean, mean) - between
                f = np.diag(between) / np.maximum(np.diag(within), 1e-300) * (n - 2)
                score = 2 * (a - b) / n
                rows.append((x["set_id"], k, manova(within, between, n)["pillai_p"], score.tolist(), [f_sf(v, 1, n - 2) for v in f], float(np.sqrt((score**2).sum())), float(score.std(ddof=1)) if d > 1 else 0.0))
            yield pd.DataFrame(rows, columns=["set_id", "size", "p", "scores", "p_contrast", "distance", "sd"])

    return with_fdr(inside.mapInPandas(run, "set_id string, size long, p double, scores array<double>, p_contrast array<double>, distance double, sd double"), "p")


def recovery_auc(ranks: DataFrame, genes: DataFrame, threshold: int) -> DataFrame:
    """motif, auc: area under the recovery curve of the genes among each motif's ranks (motif, gene, rank), below threshold."""
    n = genes.select("gene").distinct().count()
    hit = ranks.join(genes.select("gene").distinct(), "gene").where(F.col("rank") < threshold)
    w = Window.partitionBy("motif").orderBy("rank", "gene")
    hit = hit.withColumn("i", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("rank").over(w), F.lit(threshold)))
    area = hit.groupBy("motif").agg(F.sum((F.col("next") - F.col("rank")) * F.col("i")).alias("a"))
    every = ranks.select("motif").distinct()
    return every.join(area, "motif", "left").select("motif", (F.coalesce("a", F.lit(0)) / F.lit(float(threshold * max(n, 1)))).alias("auc"))


def recovery_scores(auc: DataFrame) -> DataFrame:
    """Adds nes, the z-score of auc over all motifs; 0 without spread."""
    w = Window.partitionBy()
    sd = F.stddev_samp("auc").over(w)
    return auc.withColumn("nes", F.when(sd > 0, F.try_divide(F.col("auc") - F.avg("auc").over(w), sd)).otherwise(0.0))


def rolling_mean(x: np.ndarray, window: int) -> np.ndarray:
    """Centred means, shorter at the ends."""
    half = max(window // 2, 0)
    c = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(len(x))
    lo, hi = np.maximum(i - half, 0), np.minimum(i + half + 1, len(x))
    return (c[hi] - c[lo]) / (hi - lo)


def motif_enrichment(ranks: DataFrame, genes: DataFrame, auc_threshold: int, nes_threshold: float = 3.0, max_rank: int = 5000, method: str = "icistarget", window: int = 100) -> DataFrame:
    """motif, auc, nes, rank_at_max, n_genes, leading_edge of the motifs above nes_threshold.

    The leading edge lies at the largest excess of a motif's recovery curve over mean + 2 sd of all curves; method
    approx smooths that threshold.
    """
    method = method.lower()
    if method not in ("icistarget", "approx"):
        raise ValueError("unknown method")
    scored = recovery_scores(recovery_auc(ranks, genes, auc_threshold))
    hit = ranks.join(genes.select("gene").distinct(), "gene").where((F.col("rank") > 0) & (F.col("rank") < max_rank))
    n = ranks.select("motif").distinct().count()
    # sum and square sum of all curves at each rank, from the steps alone: a curve rises by one at each hit
    w = Window.partitionBy("motif").orderBy("rank")
    steps = hit.groupBy("motif", "rank").agg(F.count("*").alias("c")).withColumn("cum", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    delta = steps.groupBy("rank").agg(F.sum("c").alias("d1"), F.sum(F.col("cum") * F.col("cum") - F.pow(F.col("cum") - F.col("c"), 2)).alias("d2")).collect()  # max_rank at most
    d1, d2 = np.zeros(max_rank), np.zeros(max_rank)
    for r in delta:
        d1[r["rank"]], d2[r["rank"]] = r.d1, r.d2
    mean, square = np.cumsum(d1) / n, np.cumsum(d2) / n
    limit = mean + 2 * np.sqrt(np.maximum(square - mean**2, 0))
    if method == "approx":
        limit[5:] = rolling_mean(limit, window)[5:]
    shared = ranks.sparkSession.sparkContext.broadcast(limit)
    strong = scored.where(F.col("nes") >= nes_threshold)

    def edge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "gene"])
        curve = np.zeros(max_rank)
        np.add.at(curve, pdf["rank"].to_numpy(), 1)
        at = int((np.cumsum(curve) - shared.value).argmax())
        got = sorted(pdf.loc[pdf["rank"] <= at, "gene"].tolist())
        return pd.DataFrame({"motif": [pdf["motif"].iloc[0]], "auc": [pdf["auc"].iloc[0]], "nes": [pdf["nes"].iloc[0]], "rank_at_max": [at], "n_genes": [len(got)], "leading_edge": [got]})

    m, g = (ranks.schema[c].dataType.simpleString() for c in ("motif", "gene"))
    return hit.join(strong, "motif").groupBy("motif").applyInPandas(edge, f"motif {m}, auc double, nes double, rank_at_max int, n_genes int, leading_edge array<{g}>")
