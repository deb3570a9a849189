"""Graphs as edge tables (src, dst, w); an undirected graph stores both directions.

Iterations are joins of the edges with a node table, stored each few rounds. Agglomeration runs in numpy on the driver behind
a size gate; ``local_moving`` is the sequential form that ``communities.louvain`` is measured against.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.operators.communities import coarsen, hierarchy, louvain, prolong  # noqa: F401 - part of this module's face
from helixframe.operators.krylov import kmeans, lanczos, mapped, product
from helixframe.plans.checkpoint import cut

#: Edges that an order-dependent method may hold on the driver.
DRIVER_EDGES = 5_000_000

#: Places that walks from all nodes reach, kept twice on the driver with 12 bytes each.
WALK_ENTRIES = 40_000_000

#: Numbers in all lines of communities together.
LINE_ENTRIES = 25_000_000


def from_names(nodes: DataFrame, edges: DataFrame, undirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes(id, name) by position and edges(src, dst, w) of edges(from, to[, w]); a missing weight is 1."""
    w = F.coalesce(F.col("w"), F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
    named = edges.select("from", "to", w.alias("w"))
    a, b = nodes.select(F.col("name").alias("from"), F.col("id").alias("src")), nodes.select(F.col("name").alias("to"), F.col("id").alias("dst"))
    out = named.join(a, "from").join(b, "to").select("src", "dst", "w")
    return nodes, both_ways(out) if undirected else out


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").union(edges.select("dst", "src", "w"))


def neighbours_of(edges: DataFrame, node: int) -> DataFrame:
    """id, w of a node's out-edges."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "w")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def total_weight(edges: DataFrame, directed: bool) -> DataFrame:
    return edges.agg((F.sum("w") / (1 if directed else 2)).alias("total"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def transition(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.try_divide("w", F.sum("w").over(Window.partitionBy("src"))))


def knn_adjacency(sim: DataFrame, k: int) -> DataFrame:
    """The k largest similarities (row, col, value) of each row, averaged with the transpose; absent entries are 0."""
    top = sim.where("row != col").withColumn("r", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("value"), "col"))).where(F.col("r") <= k)
    half = top.select("row", "col", (F.col("value") / 2).alias("value"))
    return half.union(half.select("col", "row", "value")).groupBy("row", "col").agg(F.sum("value").alias("value"))


def knn_graph(knn: DataFrame) -> DataFrame:
    """Undirected graph of neighbour lists (id, nbr); an edge listed by both ends has weight 2."""
    pairs = knn.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    return both_ways(pairs)


def laplacian(edges: DataFrame, normalised: bool = False) -> DataFrame:
    """D - A, or I - D^-1/2 A D^-1/2 (nodes of no strength get 0), as (row, col, value)."""
    nodes = nodes_of(edges)
    strength = nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")), "id", "left").na.fill(0.0, ["d"])
    if not normalised:
        every = strength.select(F.col("id").alias("row"), F.col("id").alias("col"), F.col("d").alias("value")).union(edges.select("src", "dst", -F.col("w")))
        return every.groupBy("row", "col").agg(F.sum("value").alias("value"))
    scale = strength.select("id", F.when(F.col("d") > 1e-10, 1 / F.sqrt("d")).otherwise(0.0).alias("s"))
    a, b = scale.select(F.col("id").alias("src"), F.col("s").alias("sa")), scale.select(F.col("id").alias("dst"), F.col("s").alias("sb"))
    off = edges.join(a, "src").join(b, "dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("w") * F.col("sa") * F.col("sb")).alias("value"))
    diag = nodes.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))
    return diag.union(off).groupBy("row", "col").agg(F.sum("value").alias("value"))


def page_rank(edges: DataFrame, personal: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6, every: int = 5) -> DataFrame:
    """id, rank: personalised PageRank, normalised at the end; personal(id, p), uniform by default.

    Stops when the squared change is tol or less. Mass that nodes without out-edges lose returns by the normalisation.
    """
    nodes = nodes_of(edges)
    if personal is None:
        n = nodes.count()
        start = nodes.withColumn("p", F.lit(1.0 / max(n, 1)))
    else:
        total = personal.agg(F.sum("p")).first()[0]
        start = nodes.join(personal.select("id", (F.col("p") / float(total or 1)).alias("p")), "id", "left").na.fill(0.0, ["p"])
    start = cut(start)
    share = cut(transition(edges).where("w > 0").select("src", "dst", "w"))
    rank = start.select("id", "p", F.col("p").alias("r"))
    for i in range(rounds):
        sent = share.join(rank.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("in"))
        new = rank.join(sent, "id", "left").select("id", "p", F.col("r").alias("old"), ((1 - damping) * F.col("p") + damping * F.coalesce("in", F.lit(0.0))).alias("r"))
        if (i + 1) % every == 0 or i == rounds - 1:
            new = cut(new)
            if (new.agg(F.sum(F.pow(F.col("r") - F.col("old"), 2))).first()[0] or 0) <= tol:
                rank = new.drop("old")
                break
        rank = new.drop("old")
    return _shares(rank)


def _shares(rank: DataFrame) -> DataFrame:
    """(id, rank): r as a share of all."""
    total = rank.agg(F.sum("r").alias("total"))
    return rank.crossJoin(F.broadcast(total)).select("id", F.try_divide("r", "total").alias("rank"))


def constrained_page_rank(edges: DataFrame, types: DataFrame, personal: DataFrame, damping: float = 0.85, rounds: int = 100, sink_types: Sequence[str] = (), absorbing: Sequence[str] = (), tol: float = 1e-6) -> DataFrame:
    """As page_rank, over edges(src, dst, w, etype) and types(id, ntype).

    Nodes of a sink type lose their out-edges. What flows over an absorbing edge type stays at its target for the round's
    rank but isn't passed on: it returns to the personalisation.
    """
    sinks = types.where(F.col("ntype").isin(list(sink_types))).select(F.col("id").alias("src"))
    free = edges.join(sinks, "src", "left_anti")
    share = cut(free.withColumn("w", F.try_divide("w", F.sum("w").over(Window.partitionBy("src")))).withColumn("stays", F.col("etype").isin(list(absorbing))))
    total = personal.agg(F.sum("p")).first()[0]
    rank = cut(types.select("id").join(personal.select("id", (F.col("p") / float(total or 1)).alias("p")), "id", "left").na.fill(0.0, ["p"]).withColumn("r", F.col("p")).withColumn("go", F.col("p")))
    for _ in range(rounds):
        sent = share.join(rank.select(F.col("id").alias("src"), "go"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("go") * F.col("w")).alias("in"), F.sum(F.when(F.col("stays"), 0.0).otherwise(F.col("go") * F.col("w"))).alias("on"), F.sum(F.when(F.col("stays"), F.col("go") * F.col("w")).otherwise(0.0)).alias("held"))
        back = sent.agg(F.coalesce(F.sum("held"), F.lit(0.0)).alias("back"))
        new = rank.join(sent, "id", "left").na.fill(0.0, ["in", "on"]).crossJoin(F.broadcast(back))
        home = (1 - damping + damping * F.col("back")) * F.col("p")
        new = cut(new.select("id", "p", F.col("r").alias("old"), (home + damping * F.col("in")).alias("r"), (home + damping * F.col("on")).alias("go")))
        done = (new.agg(F.sum(F.pow(F.col("r") - F.col("old"), 2))).first()[0] or 0) <= tol
        rank = new.drop("old")
        if done:
            break
    return _shares(rank)


def tied_diffusion(edges: DataFrame, personal_1: DataFrame, personal_2: DataFrame, how: str = "max", directed: bool = True, rounds: int = 1000, tol: float = 1e-7) -> DataFrame:
    """id, score: two personalised PageRanks, the second on the reversed graph if directed, combined by max, min or mean."""
    how = how.lower()
    if how not in ("max", "min", "mean"):
        raise ValueError("unknown combination")
    first = page_rank(edges, personal_1, rounds=rounds, tol=tol).withColumnRenamed("rank", "a")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w") if directed else edges
    second = page_rank(back, personal_2, rounds=rounds, tol=tol).withColumnRenamed("rank", "b")
    both = first.join(second, "id", "full_outer").na.fill(0.0, ["a", "b"])
    value = {"max": F.greatest("a", "b"), "min": F.least("a", "b"), "mean": (F.col("a") + F.col("b")) / 2}[how]
    return both.select("id", value.alias("score"))


def hop_distances(edges: DataFrame, sources: DataFrame, most: int = 1000) -> DataFrame:
    """id, hops from the nearest source; nodes out of reach are absent."""
    seen = cut(sources.select("id", F.lit(0).alias("hops")).distinct())
    front = seen
    for h in range(1, most + 1):
        front = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(h))
        front = cut(front)
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen


SYMMETRY = {"min": "min", "max": "max", "average": "avg", "avg": "avg"}


def neighbour_weights(pairs: DataFrame, symmetrise: str | bool | None = None) -> DataFrame:
    """Row-normalised (src, dst, w); symmetrise: True adds reversed edges, or min, max, average of the two directions."""
    if "w" not in pairs.columns:
        pairs = pairs.withColumn("w", F.lit(1.0))
    if symmetrise is True:
        pairs = both_ways(pairs)
    elif symmetrise:
        how = SYMMETRY.get(symmetrise.lower())
        if how is None:
            raise ValueError("unknown symmetry")
        pairs = both_ways(pairs).groupBy("src", "dst").agg(getattr(F, how)("w").alias("w"))
    return transition(pairs)


def label_spreading(weights: DataFrame, labels: DataFrame, alpha: float = 0.9, rounds: int = 100, tol: float = 1e-6, max_hops: int | None = None) -> DataFrame:
    """id, cls, value. weights: row-normalised; labels(id, cls, y, labelled).

    Unlabelled nodes take the mean of their neighbours, labelled ones alpha of their label and the rest of their
    neighbours, so anchors drift; beyond max_hops from a label a node keeps its value.
    """
    state = cut(labels.select("id", "cls", "y", "labelled", F.col("y").alias("v")))
    near = None
    if max_hops is not None:
        near = hop_distances(weights, labels.where("labelled").select("id").distinct(), max_hops).select("id").withColumn("near", F.lit(True))
        state = cut(state.join(near, "id", "left").withColumn("near", F.coalesce("near", F.lit(False))))
    else:
        state = state.withColumn("near", F.lit(True))
    for i in range(rounds):
        mean = weights.join(state.select(F.col("id").alias("dst"), "cls", "v"), "dst").groupBy(F.col("src").alias("id"), "cls").agg(F.sum(F.col("w") * F.col("v")).alias("m"))
        m = F.coalesce("m", F.lit(0.0))
        value = F.when(~F.col("near"), F.col("v")).when(F.col("labelled"), alpha * F.col("y") + (1 - alpha) * m).otherwise(m)
        new = state.join(mean, ["id", "cls"], "left").select("id", "cls", "y", "labelled", "near", F.col("v").alias("old"), value.alias("v"))
        if (i + 1) % 4 == 0 or i == rounds - 1:
            new = cut(new)
            if (new.agg(F.max(F.abs(F.col("v") - F.col("old")))).first()[0] or 0) < tol:
                state = new.drop("old")
                break
        state = new.drop("old")
    return state.select("id", "cls", F.col("v").alias("value"))


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable."""
    both = cut(both_ways(edges.withColumn("w", F.lit(1.0))).select("src", "dst").distinct())
    state = cut(nodes_of(both).withColumn("component", F.col("id")))
    while True:
        low = both.join(state.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        new = state.join(low, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        # jump to the component of the component
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(new.join(jump, "component").select("id", "old", F.least("component", "up").alias("component")))
        moved = new.where("old != component").isEmpty()
        state = new.drop("old")
        if moved:
            return state


def sign_groups(correlation: DataFrame) -> DataFrame:
    """id, sign: +1 for features in the component of feature 0 over positive correlations (col_a, col_b, value), else -1."""
    ids = nodes_of(correlation.select(F.col("col_a").alias("src"), F.col("col_b").alias("dst")))
    positive = correlation.where("value > 0").select(F.col("col_a").alias("src"), F.col("col_b").alias("dst"))
    comp = ids.join(connected_components(positive), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = comp.agg(F.min(F.struct("id", "component")).alias("x")).select(F.col("x.component").alias("zero"))
    return comp.crossJoin(F.broadcast(first)).select("id", F.when(F.col("component") == F.col("zero"), 1).otherwise(-1).alias("sign"))


def adjacency(edges: DataFrame, most: int = DRIVER_EDGES) -> tuple[list, list[dict[int, float]]]:
    """Ids and neighbour dicts on the driver; refuses graphs beyond the gate."""
    n = edges.limit(most + 1).count()
    if n > most:
        raise ValueError(f"this method takes at most {most} edges")
    rows = edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).collect()
    ids = sorted({r.src for r in rows} | {r.dst for r in rows})
    at = {v: i for i, v in enumerate(ids)}
    near: list[dict[int, float]] = [{} for _ in ids]
    for r in rows:
        near[at[r.src]][at[r.dst]] = float(r.w)
    return ids, near


def _labelled(edges: DataFrame, ids: list, label: Sequence[int]) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(v, int(c)) for v, c in zip(ids, label, strict=True)], f"id {kind}, community int")


def _relabel(label: Sequence[int]) -> list[int]:
    seen: dict[int, int] = {}
    return [seen.setdefault(c, len(seen)) for c in label]


def local_moving(near: list[dict[int, float]], resolution: float = 1.0, rounds: int = 10, seed: int = 42) -> list[int]:
    """One phase of local moving in shuffled order, no aggregation; a gain counts from 0, not from staying."""
    strength = np.array([sum(x.values()) for x in near])
    total = strength.sum()
    label = list(range(len(near)))
    size = strength.copy()
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = False
        for v in rng.permutation(len(near)).tolist():
            own = label[v]
            size[own] -= strength[v]
            weight: dict[int, float] = {}
            for u, w in near[v].items():
                if u != v:
                    weight[label[u]] = weight.get(label[u], 0.0) + w
            best, gain = own, 0.0
            for c in sorted(weight):
                g = weight[c] - resolution * strength[v] * size[c] / total
                if g > gain:
                    best, gain = c, g
            label[v] = best
            size[best] += strength[v]
            moved |= best != own
        if not moved:
            break
    return _relabel(label)


LINKAGE = ("average", "complete")


class Walks:
    """Rows of P^steps / sqrt(degree), sparse by rows and by columns: distances of walks come from them where they are asked for."""

    def __init__(self, near: list[dict[int, float]], steps: int):
        n = self.size = len(near)
        degree = np.array([max(sum(x.values()), 1e-10) for x in near])
        first = np.cumsum([0, *map(len, near)])
        to = np.fromiter((j for x in near for j in x), np.int64, first[-1])
        p = np.fromiter((w for x in near for w in x.values()), float, first[-1]) / np.repeat(degree, np.diff(first))
        start, col, value = np.arange(n + 1), np.arange(n), np.ones(n)
        for _ in range(steps):
            parts, kept = [], 0
            for i in range(0, n, 512):
                rows = np.arange(i, min(i + 512, n))
                own = slice(start[rows[0]], start[rows[-1] + 1])
                at, size = _spans(first, col[own])
                key = np.repeat(np.repeat(rows, np.diff(start[i : rows[-1] + 2])), size) * n + to[at]
                key, place = np.unique(key, return_inverse=True)
                parts.append((np.bincount(key // n - i, minlength=len(rows)), (key % n).astype(np.int32), np.bincount(place, np.repeat(value[own], size) * p[at], len(key))))
                kept += len(key)
                if kept > WALK_ENTRIES:
                    raise ValueError(f"at most {WALK_ENTRIES} places of walks")
            start = np.r_[0, np.cumsum(np.concatenate([x[0] for x in parts]))]
            col, value = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
            del parts
        self.start, self.col, self.value = start, col, value / np.sqrt(degree)[col]
        self.square = np.bincount(np.repeat(np.arange(n), np.diff(start)), self.value**2, n)
        order = np.argsort(col, kind="stable")
        self.c_start = np.r_[0, np.cumsum(np.bincount(col, minlength=n))]
        self.c_row = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))[order]
        self.c_value = self.value[order]
        self.line = np.zeros(n)

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of one node's walk from those of others."""
        own = slice(self.start[i], self.start[i + 1])
        col, value = self.col[own], self.value[own]
        through = (self.c_start[col + 1] - self.c_start[col]).sum()
        if (self.start[others + 1] - self.start[others]).sum() > through:
            at, size = _spans(self.c_start, col)
            dot = np.bincount(self.c_row[at], np.repeat(value, size) * self.c_value[at], self.size)[others]
        else:
            self.line[col] = value
            at, size = _spans(self.start, others)
            dot = np.bincount(np.repeat(np.arange(len(others)), size), self.line[self.col[at]] * self.value[at], len(others))
            self.line[col] = 0
        return np.sqrt(np.maximum(self.square[i] + self.square[others] - 2 * dot, 0))


def _spans(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows, row after row, and the rows' sizes."""
    size = start[rows + 1] - start[rows]
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start[rows] - (end - size), size), size


def walktrap_labels(near: list[dict[int, float]], steps: int, clusters: int, linkage: str = "complete") -> list[int]:
    """Agglomerates adjacent communities by random-walk distance until ``clusters`` are left.

    Kept are the sums (or maxima) of distances between adjacent communities; a merge adds up its parts', and a part that
    was not adjacent before is measured then. Large communities keep a line, their sums to each node; there are as many as
    LINE_ENTRIES allow, so no table of all pairs of nodes exists.
    """
    if linkage not in LINKAGE:
        raise ValueError("unknown linkage")
    n = len(near)
    if n <= clusters:
        return list(range(n))
    walks, average = Walks(near, steps), linkage == "average"
    members = {i: np.array([i]) for i in range(n)}
    add, total = (np.add, np.sum) if average else (np.maximum, np.max)
    mean = lambda v, a, b: v / (len(members[a]) * len(members[b])) if average else v
    large, lines = max(2, n * n // LINE_ENTRIES), {}

    def measured(b: int, every: list[int]) -> dict[int, float]:
        """The sums (or maxima) between a community and others: by a line where one of both has it, else walk by walk."""
        out, rest = {}, []
        for c in every:
            line, at = (lines.get(b), c) if len(members[c]) <= len(members[b]) else (lines.get(c), b)
            if line is None:
                rest.append(c)
            else:
                out[c] = float(total(line[members[at]]))
        if rest:
            start = np.cumsum([0, *(len(members[c]) for c in rest)])[:-1]
            others = np.concatenate([members[c] for c in rest])
            each = add.reduce([walks.distances(i, others) for i in members[b].tolist()])
            out |= zip(rest, add.reduceat(each, start).tolist(), strict=True)
        return out

    link: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for i, x in enumerate(near):
        others = np.array([j for j in x if j > i or (j < i and i not in near[j])], np.int64)
        for j, d in zip(others.tolist(), walks.distances(i, others).tolist(), strict=True):
            link[i][j] = link[j][i] = d
    heap = [(d, i, j) for i in link for j, d in link[i].items() if i < j]
    heapq.heapify(heap)
    new, every = n, np.arange(n)
    while len(members) > clusters and heap:
        _, a, b = heapq.heappop(heap)
        if a not in members or b not in members:
            continue
        left, right = link.pop(a), link.pop(b)
        left |= measured(a, [c for c in right if c not in left and c != a])
        right |= measured(b, [c for c in left if c not in right and c != b])
        link[new] = {c: float(add(v, right[c])) for c, v in left.items() if c != b}
        own = [lines.pop(x, None) for x in (a, b)]
        if len(members[a]) + len(members[b]) >= large:
            for x, line in zip((a, b), own, strict=True):
                for i in members[x].tolist() if line is None else ():
                    line = walks.distances(i, every) if line is None else add(line, walks.distances(i, every), out=line)
                lines[new] = add(lines[new], line, out=lines[new]) if new in lines else line
        members[new] = np.concatenate([members.pop(a), members.pop(b)])
        for c, v in link[new].items():
            link[c].pop(a, None)
            link[c].pop(b, None)
            link[c][new] = v
            heapq.heappush(heap, (mean(v, c, new), c, new))
        new += 1
    label = [0] * n
    for c, m in members.items():
        for i in m.tolist():
            label[i] = c
    return _relabel(label)


def walktrap(edges: DataFrame, steps: int = 4, clusters: int = 2, linkage: str = "complete") -> DataFrame:
    ids, near = adjacency(edges)
    return _labelled(edges, ids, walktrap_labels(near, steps, clusters, linkage))


def walk_distributions(edges: DataFrame, steps: int) -> DataFrame:
    """(row, col, value): where a walk of that many steps from row ends."""
    one = transition(edges).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("value"))
    from helixframe.operators.matrix import matmul

    out = one
    for _ in range(steps - 1):
        out = cut(matmul(out, one))
    return out


def farthest_first_kmeans(x: np.ndarray, k: int, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """Lloyd's rounds from a random first centre and the farthest points after it."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[int(d.argmax())])
    c = np.array(centres)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def spectral(sim: DataFrame, k_neighbours: int, clusters: int, rounds: int = 100, seed: int = 42, steps: int = 8) -> DataFrame:
    """id, community from the smallest eigenvectors of the normalised Laplacian of the neighbour graph, row by row made unit.

    They are the largest of I + D^-1/2 A D^-1/2, found by block Lanczos on the edges; k-means runs over tables too.
    """
    adj = cut(knn_adjacency(sim, k_neighbours).select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("w")))
    nodes = cut(nodes_of(adj))
    one = F.lit(1.0).alias("value")
    # the Laplacian with its sign turned and 2 on the diagonal
    shifted = cut(laplacian(adj, True).select("row", "col", (-F.col("value")).alias("value")).union(nodes.select("id", F.col("id"), one * 2)).groupBy("row", "col").agg(F.sum("value").alias("value")))
    _, vectors = lanczos(lambda v, width: product(shifted, v, width), nodes, clusters, steps=steps, seed=seed)
    rows = mapped(vectors, lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10))
    return kmeans(rows, clusters, rounds, seed)
