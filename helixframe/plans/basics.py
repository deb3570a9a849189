"""Registered queries of stores, files, small matrix, graph and vector helpers, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import tables as T
from helixframe.functions import columns as K
from helixframe.operators import cells as C
from helixframe.operators import enrichment as E
from helixframe.operators import fusion as U
from helixframe.operators import graph as G
from helixframe.operators import hotspot as H
from helixframe.operators import info as I
from helixframe.operators import matrix as M
from helixframe.operators import neighbours as N
from helixframe.operators import ontology as O
from helixframe.operators import similarity as S
from helixframe.operators import stats as Z
from helixframe.plans.checkpoint import cut, scratch
from helixframe.plans.relational import _EXPR, ORACLE_SQL, _expression, _nn, _norm, r6, register
from helixframe.plans.unrolled import _SPATIAL, gamma_p, put
from helixframe.sources import formats, store

# ---- stores and files ----------------------------------------------------------------------------------------------


def _stored(spark, d):
    path = scratch(spark, "store")
    store.write(T.counts(spark, d), path)
    return path


@register("SELECT cell, gene, raw, round(norm, 6) AS norm FROM norm", "norm")
def store_by_cells(spark, d):
    return r6(store.read(spark, _stored(spark, d)), "norm").select("cell", "gene", "raw", "norm")


@register("SELECT cell, gene, raw, round(norm, 6) AS norm FROM norm WHERE gene % 3 = 0", "norm")
def store_by_genes(spark, d):
    return r6(store.read(spark, _stored(spark, d), "genes").where("gene % 3 = 0"), "norm").select("cell", "gene", "raw", "norm")


@register("SELECT cell, gene, raw, CAST(pos AS INTEGER) AS pos FROM counts JOIN (SELECT unnest([5, 1, 7, 44, 999999]) AS cell, unnest([0, 1, 2, 3, 4]) AS pos) w USING (cell)", "counts")
def store_cell_ids(spark, d):
    return store.read_ids(spark, _stored(spark, d), [5, 1, 7, 44, 999_999]).select("cell", "gene", "raw", "pos")


@register("SELECT cell, gene, raw, CAST(pos AS INTEGER) AS pos FROM counts JOIN (SELECT unnest([20, 3, 11]) AS gene, unnest([0, 1, 2]) AS pos) w USING (gene)", "counts")
def store_gene_ids(spark, d):
    return store.read_ids(spark, _stored(spark, d), [20, 3, 11], "genes").select("cell", "gene", "raw", "pos")


@register("SELECT cell, gene, raw FROM counts WHERE cell >= 10 AND cell < 60", "counts")
def store_cell_range(spark, d):
    return store.read_range(spark, _stored(spark, d), 10, 60).select("cell", "gene", "raw")


@register("SELECT cell, CAST(sum(raw) AS BIGINT) AS lib_size FROM counts GROUP BY 1", "counts")
def store_library_sizes(spark, d):
    return store.library_sizes(spark, _stored(spark, d))


@register("SELECT gene, CAST(count(*) AS BIGINT) AS nnz FROM counts GROUP BY 1", "counts")
def store_gene_nnz(spark, d):
    return store.gene_nnz(spark, _stored(spark, d))


@register("SELECT CAST(count(DISTINCT cell) AS BIGINT) AS cells, CAST(count(DISTINCT gene) AS BIGINT) AS genes, CAST(count(*) AS BIGINT) AS nnz, CAST(3 AS INTEGER) AS version, CAST(10000 AS DOUBLE) AS target FROM counts", "counts")
def store_header(spark, d):
    return store.header(spark, _stored(spark, d))


@register("SELECT cell, gene, raw, round(norm, 6) AS norm, typeof(raw) = 'INTEGER' AS wide FROM norm", "norm")
def store_migrated(spark, d):
    old, new = scratch(spark, "store"), scratch(spark, "store")
    store.write_version_2(T.counts(spark, d), old)
    store.migrate(spark, old, new)
    out = store.read(spark, new)
    return r6(out, "norm").select("cell", "gene", "raw", "norm", (F.typeof("raw") == "int").alias("wide"))


@register("SELECT gene, cell, raw FROM counts", "counts")
def matrix_market_round_trip(spark, d):
    path, counts = scratch(spark, "counts.mtx"), T.counts(spark, d)
    formats.write_matrix_market(counts, path, 10**6, 10**6, cells_as_rows=False)
    return formats.matrix_market(spark, path, cells_as_rows=False).select("gene", "cell", "raw")


@register("SELECT cell, gene, raw FROM (SELECT *, count(*) OVER (PARTITION BY cell) AS nnz, sum(raw) OVER (PARTITION BY cell) AS lib FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING count(*) >= 20)) z WHERE nnz >= 20 AND lib >= 500", "counts")
def matrix_market_quality(spark, d):
    path = scratch(spark, "counts.mtx")
    formats.write_matrix_market(T.counts(spark, d), path, 10**6, 10**6)
    return formats.matrix_market_quality(spark, path, 20, 20, 500)


@register("SELECT c_custkey AS cell, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 ELSE -1 END AS metacell FROM customer")
def metacell_assignments(spark, d):
    c = T.cells(spark, d)
    out = C.assignments(c, c.where("cell % 3 = 0").select((F.col("cell") % 50).alias("metacell"), "cell"))
    return out.na.fill(-1, ["metacell"])


# ---- matrices ------------------------------------------------------------------------------------------------------


def _m(spark, d, flipped=False):
    e = T.edges(spark, d)
    if flipped:
        return e.where("src != dst").select(F.col("dst").alias("row"), F.col("src").alias("col"), (F.col("w") / 2).alias("value"))
    return e.where("w > 20").select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("value"))


@register("SELECT col AS row, row AS col, value FROM a", "a")
def sparse_transpose(spark, d):
    return M.transpose(_m(spark, d))


@register("SELECT row, col, value * 2.5 AS value FROM a", "a")
def sparse_scale(spark, d):
    return M.scale(_m(spark, d), 2.5)


@register("SELECT row, col, value FROM a WHERE col > row", "a")
def upper_triangle(spark, d):
    return M.upper_triangle(_m(spark, d))


@register("SELECT row, col, value - 24 AS value FROM a WHERE value <> 24", "a")
def sparse_from_dense(spark, d):
    return M.from_dense(_m(spark, d).withColumn("value", F.col("value") - 24))


@register("SELECT row, col, value FROM a UNION ALL SELECT row + 25, col, value FROM b", "a", "b")
def bound_rows(spark, d):
    return M.bind_rows([(_m(spark, d), 25), (_m(spark, d, True), 25)])


@register("SELECT row, col, value FROM a UNION ALL SELECT row, col + 25, value FROM b", "a", "b")
def bound_columns(spark, d):
    return M.bind_cols([(_m(spark, d), 25), (_m(spark, d, True), 25)]).select("row", "col", "value")


@register("SELECT CASE WHEN row > 3 THEN row - 1 ELSE row END AS row, col, value FROM a WHERE row <> 3", "a")
def dropped_row(spark, d):
    return M.drop_row(_m(spark, d), 3)


@register("SELECT r.row, CAST(c.i AS BIGINT) AS col, coalesce(value, 0) AS value FROM (SELECT DISTINCT row FROM a) r CROSS JOIN range(0, 25) c(i) LEFT JOIN a ON a.row = r.row AND a.col = c.i", "a")
def dense_lists(spark, d):
    return M.from_lists(M.to_lists(_m(spark, d), 25))


@register("SELECT id AS row, id AS col, d AS value FROM deg", "deg")
def diagonal_matrix(spark, d):
    und = G.both_ways(T.edges(spark, d).where("src < dst"))
    return M.diagonal(und.groupBy(F.col("src").alias("i")).agg(F.sum("w").alias("x")))


@register("SELECT row, col, round(value / sum(value) OVER (PARTITION BY col), 9) AS value FROM a WHERE value > 25", "a")
def pruned_columns(spark, d):
    return M.prune(_m(spark, d), 25.0).withColumn("value", F.round("value", 9))


@register("SELECT row, col, round(value / sum(value) OVER (PARTITION BY col), 9) AS value FROM a", "a")
def columns_l1(spark, d):
    return M.normalise_l1(_m(spark, d), "col").withColumn("value", F.round("value", 9))


@register("SELECT row, col, dense_rank() OVER (ORDER BY row) - 1 AS at FROM a WHERE row % 2 = 1", "a")
def reindexed_rows(spark, d):
    odd = _m(spark, d).where("row % 2 = 1").withColumn("name", F.col("row"))
    return M.reindex(odd, "name", "at")[0].select("row", "col", "at")


@register("SELECT col_a, col_b, round(corr(a, b), 6) AS value FROM mp GROUP BY 1, 2 UNION ALL SELECT DISTINCT col, col, 1.0 FROM m", "mp")
def correlation_from_covariance(spark, d):
    return r6(S.cov_to_cor(S.covariance(T.matrix(spark, d))), "value")


@register("SELECT col_a, col_b, round(-sum(p * ln(p)), 6) AS joint_entropy FROM (SELECT col_a, col_b, count(*) / CAST(sum(count(*)) OVER (PARTITION BY col_a, col_b) AS DOUBLE) AS p FROM mp GROUP BY col_a, col_b, CAST(floor(a * 10) AS BIGINT) % 7, CAST(floor(b * 10) AS BIGINT) % 7) z GROUP BY 1, 2", "mp")
def joint_entropies(spark, d):
    binned = T.matrix(spark, d).withColumn("bin", (F.floor(F.col("value") * 10) % 7).cast("int"))
    return r6(I.mutual_information(binned).select("col_a", "col_b", "joint_entropy"), "joint_entropy")


# ---- graphs, vectors, terms ----------------------------------------------------------------------------------------


@register("SELECT CAST(count(DISTINCT src) AS BIGINT) AS nodes, sum(w) / 2 AS total FROM und", "und")
def graph_size(spark, d):
    und = G.both_ways(T.edges(spark, d).where("src < dst"))
    return G.total_weight(und, False).crossJoin(G.nodes_of(und).agg(F.count("*").alias("nodes"))).select("nodes", "total")


@register("SELECT dst AS id, w FROM und WHERE src = 3", "und")
def node_neighbours(spark, d):
    return G.neighbours_of(G.both_ways(T.edges(spark, d).where("src < dst")), 3)


@register("SELECT src, dst, w FROM und", "und")
def graph_from_names(spark, d):
    n = T.load(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    e = T.edges(spark, d).where("src < dst")
    named = e.join(n.select(F.col("id").alias("src"), F.col("name").alias("from")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("to")), "dst").select("from", "to", "w")
    return G.from_names(n, named, undirected=True)[1]


@register("SELECT id, round(sqrt(list_dot_product(vec, vec)), 6) AS length, round(list_dot_product(vec, vec), 6) AS square, round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) AS first, round(list_max(vec), 6) AS high, round(list_min(vec), 6) AS low FROM points", "points")
def vector_summaries(spark, d):
    p = T.embedding(spark, d).select("id", "vec")
    u = N.cosine_normalised(p).select("id", F.col("vec")[0].alias("first"))
    ends = K.array_min_max(F.col("vec"))
    out = p.select("id", K.norm(F.col("vec")).alias("length"), K.dot(F.col("vec"), F.col("vec")).alias("square"), ends["max"].alias("high"), ends["min"].alias("low")).join(u, "id")
    return r6(out, "length", "square", "first", "high", "low")


@register("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS total FROM events")
def running_totals(spark, d):
    e = T.load(spark, d, "events")
    return r6(e.select("event_id", K.cumulative("value", ["event_id"], ["user_id"]).alias("total")), "total")


@register("SELECT gene, round(ln(p / (1 - p)), 6) AS q, round(p, 9) AS back FROM (SELECT gene, 1 / (1 + exp(-stat * 8)) AS p FROM stats) x", "stats")
def logits(spark, d):
    x = T.gene_stats(spark, d).select("gene", (1 / (1 + F.exp(-F.col("stat") * 8))).alias("p"))
    q = K.logit(F.col("p"))
    return x.select("gene", F.round(q, 6).alias("q"), F.round(K.inv_logit(q), 9).alias("back"))


@register("SELECT id, round(dist, 9) AS dist FROM nn WHERE rank = 5 AND id % 10 = 0", "nn")
def kth_distances(spark, d):
    nn = _nn(spark, d)
    out = N.kth_distance(nn, nn.where("id % 10 = 0").select(F.col("id").alias("index")).distinct(), 5)
    return out.select(F.col("index").alias("id"), F.round("dist", 9).alias("dist"))


@register("SELECT id, string_agg(CAST(nbr AS VARCHAR), ',' ORDER BY rank) AS nn FROM (SELECT id, nbr, rank FROM nn UNION ALL SELECT DISTINCT id, id, 0 FROM nn) z GROUP BY 1", "nn")
def neighbour_lists(spark, d):
    return N.neighbour_lists(_nn(spark, d), self_first=True).select("id", F.array_join("nn", ",").alias("nn"))


@register("SELECT x.id, round(s / (20.0 - s), 9) AS jaccard, round(s / 10.0, 9) AS overlap FROM (SELECT DISTINCT id FROM nn) x JOIN (SELECT a.id, count(b.id) AS s FROM nn a LEFT JOIN nn b ON b.id = a.id + 1 AND b.nbr = a.nbr GROUP BY 1) z ON z.id = x.id WHERE x.id + 1 IN (SELECT id FROM nn)", "nn")
def list_overlaps(spark, d):
    lists = N.neighbour_lists(_nn(spark, d))
    both = lists.join(lists.select((F.col("id") - 1).alias("id"), F.col("nn").alias("other")), "id")
    return both.select("id", F.round(K.jaccard(F.col("nn"), F.col("other")), 9).alias("jaccard"), F.round(K.overlap(F.col("nn"), F.col("other")), 9).alias("overlap"))


@register("SELECT term, CAST(count(*) AS BIGINT) AS size FROM tg GROUP BY 1", "tg")
def term_sizes(spark, d):
    return O.term_sizes(T.term_genes(spark, d))


ORACLE_SQL["similar_terms"] = f"SELECT * FROM ({ORACLE_SQL['wang_similarity']}) w WHERE value >= 0.5"


@register()
def similar_terms(spark, d):
    return r6(O.filter_similar(O.wang(T.ontology_edges(spark, d)), 0.5), "value")


# ---- set variation, motifs, fusion, pairs of genes -----------------------------------------------------------------

_TAIL = f"({gamma_p('0.5', '(u * u / 2.0)')})"
_DENSITY = f"SELECT gene, sample, avg(CASE WHEN u > 0 THEN 0.5 + {_TAIL} / 2 ELSE 0.5 - {_TAIL} / 2 END) AS t FROM (SELECT x.gene, x.sample, (x.value - y.value) / width AS u FROM ({_EXPR}) x JOIN ({_EXPR}) y ON y.gene = x.gene JOIN (SELECT gene, greatest(coalesce(stddev_samp(value), 0) / 4, 0.001) AS width FROM ({_EXPR}) e GROUP BY 1) w ON w.gene = x.gene) p GROUP BY 1, 2"
put(
    "kernel_densities",
    f"SELECT gene, sample, round(-ln((1 - t) / greatest(t, 1e-15)), 4) AS value FROM ({_DENSITY}) k",
)


@register()
def kernel_densities(spark, d):
    return E.kernel_density(_expression(spark, d)).withColumn("value", F.round("value", 4))


_POISSON = f"SELECT x.gene, x.sample, avg(1 - ({gamma_p('(x.value + 1)', '(y.value + 0.5)', 2500, 1e9)})) AS t FROM ({_EXPR}) x JOIN ({_EXPR}) y ON y.gene = x.gene GROUP BY 1, 2"


def _variation(density: str) -> str:
    """Random walks over the ranks of rounded kernel densities."""
    value = f"SELECT gene, sample, round(-ln((1 - t) / greatest(t, 1e-15)), 4) AS value FROM ({density}) k"
    walk = f"SELECT *, row_number() OVER (PARTITION BY set_id, sample ORDER BY pos) AS i, count(*) OVER (PARTITION BY set_id, sample) AS k, sum(wt) OVER (PARTITION BY set_id, sample) AS total, sum(wt) OVER (PARTITION BY set_id, sample ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT gene, sample, n, pos, abs(n - pos + 1 - n / 2.0) AS wt FROM (SELECT *, count(*) OVER (PARTITION BY sample) AS n, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS pos FROM ({value}) e) r) q JOIN sets USING (gene)"
    return f"SELECT set_id, sample, round(greatest(max(cum / total - miss), 0) + least(min((cum - wt) / total - miss), 0), 6) AS score FROM (SELECT *, (pos - i) / CAST(n - k AS DOUBLE) AS miss FROM ({walk}) y) z GROUP BY 1, 2"


put("set_variation", _variation(_DENSITY), ("sets",))
put("set_variation_poisson", _variation(_POISSON), ("sets",))
put("gene_pair_correlation", """SELECT gene_a, gene_b, round(lc / sqrt(ta * tb) / 2, 6) AS c, round(CASE WHEN abs(lc / sqrt(ea)) < abs(lc / sqrt(eb)) THEN lc / sqrt(ea) ELSE lc / sqrt(eb) END, 6) AS z FROM (
    SELECT a.gene AS gene_a, b.gene AS gene_b, sum(a.wx * b.x) AS lc FROM wxs a JOIN xs b ON b.cell = a.cell AND a.gene < b.gene GROUP BY 1, 2) l
    JOIN ab p ON p.gene = gene_a JOIN (SELECT gene, ea AS eb, ta AS tb FROM ab) q ON q.gene = gene_b""",
    ("counts",), *_SPATIAL,
    ("few", "SELECT gene, cell, umi, raw FROM grid WHERE gene % 50 = 0"),
    ("line", "SELECT gene, regr_slope(raw, ln(umi)) AS s, regr_intercept(raw, ln(umi)) AS i, count(*) AS n FROM few GROUP BY 1"),
    ("xs", "SELECT gene, cell, r / sqrt(sum(r * r) OVER (PARTITION BY gene) / (n - 2)) AS x FROM (SELECT few.gene, cell, n, raw - i - s * ln(umi) AS r FROM few JOIN line USING (gene)) y"),
    ("wxs", "SELECT gene, u.src AS cell, sum(w * x) AS wx FROM (SELECT src, dst, w FROM wt UNION ALL SELECT dst, src, w FROM wt) u JOIN xs ON xs.cell = u.dst GROUP BY 1, 2"),
    ("ab", "SELECT gene, ea, ta FROM (SELECT gene, sum(wx * wx) AS ea FROM wxs GROUP BY 1) e JOIN (SELECT gene, sum(d * x * x) / 2 AS ta FROM xs JOIN dg USING (cell) GROUP BY 1) t USING (gene)"),
)


@register()
def gene_pair_correlation(spark, d):
    from helixframe.plans.iterative import _spatial

    counts, umi, w = _spatial(spark, d)
    return r6(H.sparse_pair_correlation(counts, umi, w, counts.where("gene % 50 = 0")), "c", "z")


def _fusion_sql(k: int, rounds: int) -> None:
    """Network fusion of two views of suppliers, written out."""
    steps = [
        ("f1", "SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 1.0 AS y FROM supplier"),
        ("z1", "SELECT id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM f1"),
        ("d1", "SELECT a.id AS row, b.id AS col, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS value FROM z1 a JOIN z1 b ON a.id <> b.id"),
        ("f2", "SELECT s_suppkey AS id, s_nationkey % 5 AS x, length(s_name) % 4 AS y FROM supplier"),
        ("d2", "SELECT a.id AS row, b.id AS col, ((CASE WHEN a.x <> b.x THEN 1.0 ELSE 0 END) + (CASE WHEN a.y <> b.y THEN 1.0 ELSE 0 END)) / 2 AS value FROM f2 a JOIN f2 b ON a.id <> b.id"),
    ]
    status = "SELECT row, col, CASE WHEN row = col THEN 0.5 ELSE coalesce(value / nullif(2 * sum(CASE WHEN row <> col THEN value END) OVER (PARTITION BY row), 0), 0) END AS value FROM {}"
    for v in (1, 2):
        steps += [
            (f"m{v}", f"SELECT row, avg(value) AS m FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY value, col) AS r FROM d{v}) q WHERE r <= {k} GROUP BY 1"),
            (f"a{v}", f"SELECT row, col, CASE WHEN s > 0 THEN exp(-value * value / (2 * s * s)) ELSE 1.0 END AS value FROM (SELECT d.row, d.col, d.value, 0.5 * (x.m + y.m + d.value) / 3 AS s FROM d{v} d JOIN m{v} x ON x.row = d.row JOIN m{v} y ON y.row = d.col) q UNION ALL SELECT row, row, 1.0 FROM m{v}"),
            (f"w{v}", f"SELECT row, col, value / sum(value) OVER (PARTITION BY row) AS value FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY value DESC, col) AS r FROM a{v}) q WHERE r <= {k}"),
            (f"p{v}_0", status.format(f"a{v}")),
        ]
    for i in range(1, rounds + 1):
        for v, other in ((1, f"p2_{i - 1}"), (2, f"p1_{i}")):
            steps.append((f"h{v}_{i}", f"SELECT w.row, p.col, sum(w.value * p.value) AS value FROM w{v} w JOIN {other} p ON p.row = w.col GROUP BY 1, 2"))
            steps.append((f"q{v}_{i}", f"SELECT h.row, w.row AS col, sum(h.value * w.value) AS value FROM h{v}_{i} h JOIN w{v} w ON w.col = h.col GROUP BY 1, 2"))
            steps.append((f"p{v}_{i}", status.format(f"q{v}_{i}")))
    steps.append(("e", f"SELECT row, col, value / sum(value) OVER (PARTITION BY row) AS value FROM (SELECT row, col, sum(value) / 2 AS value FROM (SELECT * FROM p1_{rounds} UNION ALL SELECT * FROM p2_{rounds}) u GROUP BY 1, 2) m"))
    put("fused_network", "SELECT row, col, round(CASE WHEN row = col THEN 1.0 ELSE sum(value) END, 9) AS value FROM (SELECT row, col, value / 2 AS value FROM e UNION ALL SELECT col, row, value / 2 FROM e) t GROUP BY 1, 2", (), *steps)


_fusion_sql(10, 3)


@register()
def fused_network(spark, d):
    s = T.load(spark, d, "supplier")
    one = M.transpose(T.melt(s.select(F.col("s_suppkey").alias("row"), F.col("s_acctbal").alias("a"), (F.col("s_nationkey") * 1.0).alias("b")), "row")).select("row", "col", "value")
    two = M.transpose(T.melt(s.select(F.col("s_suppkey").alias("row"), (F.col("s_nationkey") % 5).alias("x"), (F.length("s_name") % 4).cast("int").alias("y")), "row")).select("row", "col", F.col("value").cast("double").alias("value"))
    out = U.fuse([cut(U.affinity_continuous(one, k=10)), cut(U.affinity_categorical(two, 10))], 10, 3)
    return out.withColumn("value", F.round("value", 9))
