"""Oracles of iterative queries: SQL with a fixed number of rounds written out, or recursive."""

from __future__ import annotations

from helixframe.plans.relational import _CLOSURE, _HITS, ORACLE_SQL, sql

#: Rounds written out of diffusions that end by their tolerance before that.
SETTLED = 40
#: All rounds that a PageRank to the last digit may take.
WHOLE = 100


def put(name: str, body: str, needs: tuple[str, ...] = (), *steps: tuple[str, str]) -> None:
    """Registers a body after the expressions it needs and named steps, each computed once."""
    head = sql("", *needs).strip().removeprefix("WITH ")
    parts = [head] * bool(head) + [f"{n} AS MATERIALIZED ({s})" for n, s in steps]
    ORACLE_SQL[name] = ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body


def rounds(tag: str, first: str, step: str, n: int) -> list[tuple[str, str]]:
    """Steps tag0..tagn; {p} in a step is the one before."""
    return [(f"{tag}0", first)] + [(f"{tag}{i + 1}", step.replace("{p}", f"{tag}{i}")) for i in range(n)]


def gamma_p(a: str, x: str, terms: int = 600, most: float = 250) -> str:
    """The regularised lower incomplete gamma function by its series; 1 for x beyond most."""
    return f"CASE WHEN {x} <= 0 THEN 0 WHEN {x} > {most} THEN 1 ELSE list_sum(list_transform(range(0, {terms}), lambda k: exp((k + {a}) * ln({x}) - {x} - lgamma({a} + k + 1)))) END"


def two_sided(z: str) -> str:
    return f"(1 - ({gamma_p('0.5', f'({z}) * ({z}) / 2.0')}))"


def greater(z: str) -> str:
    return f"(CASE WHEN {z} > 0 THEN {two_sided(z)} / 2 ELSE 1 - {two_sided(z)} / 2 END)"


def hypergeometric(q: str, m: str, n: str, k: str) -> str:
    """P(X > q) of k draws from n, m of them marked; 1 for q = 0."""
    one = f"lgamma({m} + 1.0) - lgamma(x + 1.0) - lgamma({m} - x + 1.0) + lgamma({n} - {m} + 1.0) - lgamma({k} - x + 1.0) - lgamma({n} - {m} - {k} + x + 1.0) - lgamma({n} + 1.0) + lgamma({k} + 1.0) + lgamma({n} - {k} + 1.0)"
    return f"CASE WHEN {q} = 0 THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform(range(greatest({q} + 1, {k} - ({n} - {m})), least({k}, {m}) + 1), lambda x: exp({one}))), 0)) END"


def with_fdr(rows: str) -> str:
    """Rows with p, and their Benjamini-Hochberg fdr."""
    return f"SELECT * EXCLUDE (i_, n_), least(min(p * n_ / i_) OVER (ORDER BY i_ DESC ROWS UNBOUNDED PRECEDING), 1.0) AS fdr FROM (SELECT *, row_number() OVER (ORDER BY p) AS i_, count(*) OVER () AS n_ FROM ({rows}) a_) b_"


# ---- diffusions ----------------------------------------------------------------------------------------------------

_SHARE = ("share", "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM und")
_WALK = "SELECT r.id, p, 0.15 * p + 0.85 * coalesce(x, 0) AS r FROM {p} r LEFT JOIN (SELECT dst AS id, sum(q.r * w) AS x FROM share JOIN {p} q ON q.id = src GROUP BY 1) s USING (id)"


def _start(weights: str) -> str:
    return f"SELECT id, p, p AS r FROM (SELECT id, ({weights}) AS p FROM (SELECT DISTINCT src AS id FROM und) n) s"


def settled(tag: str, every: int, tol: float, last: int = SETTLED) -> tuple[str, str]:
    """tag_end (id, r): the first of the looked-at rounds whose squared change is tol or less."""
    seen = " UNION ALL ".join(f"SELECT {i} AS i, x.id, x.r, (SELECT sum((u.r - v.r) ** 2) FROM {tag}{i} u JOIN {tag}{i - 1} v USING (id)) AS d FROM {tag}{i} x" for i in range(every, last + 1, every))
    return f"{tag}_end", f"SELECT id, r FROM (SELECT *, min(CASE WHEN d <= {tol} THEN i END) OVER () AS first FROM ({seen}) z) y WHERE i = first"


put("page_rank", "SELECT id, round(r / sum(r) OVER (), 9) AS rank FROM a_end", ("und",), _SHARE, *rounds("a", _start("1.0 / count(*) OVER ()"), _WALK, WHOLE), settled("a", 5, 1e-20, WHOLE))
_OWN = "CASE id WHEN 0 THEN 1.0 / 3 WHEN 3 THEN 2.0 / 3 ELSE 0 END"
put("personalised_page_rank", "SELECT id, round(r / sum(r) OVER (), 9) AS rank FROM a_end", ("und",), _SHARE, *rounds("a", _start(_OWN), _WALK, SETTLED), settled("a", 5, 1e-6))
_ONE, _TWO = (f"CASE WHEN id IN ({x}) THEN 0.5 ELSE 0 END" for x in ("0, 1", "2, 3"))
put(
    "tied_diffusion",
    "SELECT id, round((a.r / (SELECT sum(r) FROM a_end) + b.r / (SELECT sum(r) FROM b_end)) / 2, 9) AS score FROM a_end a JOIN b_end b USING (id)",
    ("und",),
    _SHARE,
    *rounds("a", _start(_ONE), _WALK, SETTLED),
    settled("a", 5, 1e-7),
    *rounds("b", _start(_TWO), _WALK, SETTLED),
    settled("b", 5, 1e-7),
)
_TYPED = ("share", "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w, w <= 20 AS stays FROM und WHERE src % 5 <> 0")
_TYPED_WALK = """SELECT id, p, home + 0.85 * coalesce(x, 0) AS r, home + 0.85 * coalesce(y, 0) AS go FROM (
    SELECT r.id, p, x, y, (0.15 + 0.85 * (SELECT coalesce(sum(go * w), 0) FROM share JOIN {p} ON id = src WHERE stays)) * p AS home FROM {p} r
    LEFT JOIN (SELECT dst AS id, sum(go * w) AS x, sum(CASE WHEN stays THEN 0 ELSE go * w END) AS y FROM share JOIN {p} q ON q.id = src GROUP BY 1) s USING (id)) t"""
_TYPED_START = "SELECT id, CASE WHEN id IN (1, 2) THEN 0.5 ELSE 0 END AS p, p AS r, p AS go FROM (SELECT DISTINCT src AS id FROM und) n"
put("constrained_page_rank", "SELECT id, round(r / sum(r) OVER (), 9) AS rank FROM a_end", ("und",), _TYPED, *rounds("a", _TYPED_START, _TYPED_WALK, WHOLE), settled("a", 1, 1e-20, WHOLE))
put(
    "walk_distributions",
    "SELECT row, col, round(value, 9) AS value FROM t2",
    ("und",),
    _SHARE,
    *rounds("t", "SELECT src AS row, dst AS col, w AS value FROM share", "SELECT t.row, dst AS col, sum(value * w) AS value FROM {p} t JOIN share ON src = t.col GROUP BY 1, 2", 2),
)
_SPREAD = """SELECT s.id, s.cls, y, labelled, near, CASE WHEN NOT near THEN v WHEN labelled THEN 0.9 * y + 0.1 * coalesce(m, 0) ELSE coalesce(m, 0) END AS v FROM {p} s
    LEFT JOIN (SELECT src AS id, cls, sum(w * v) AS m FROM wts JOIN {p} q ON q.id = dst GROUP BY 1, 2) z ON z.id = s.id AND z.cls = s.cls"""
put(
    "label_spreading",
    "SELECT id, cls, round(v, 9) AS value FROM s12",
    ("nn",),
    ("wts", "SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM (SELECT id AS src, nbr AS dst FROM nn UNION ALL SELECT nbr, id FROM nn) e"),
    *rounds("h", "SELECT id FROM points WHERE id % 4 = 0", "SELECT DISTINCT id FROM (SELECT id FROM {p} UNION ALL SELECT dst FROM wts JOIN {p} ON id = src) u", 6),
    *rounds("s", "SELECT id, cls, CASE WHEN id % 4 = 0 AND batch = cls THEN 1.0 ELSE 0.0 END AS y, id % 4 = 0 AS labelled, id IN (SELECT id FROM h6) AS near, y AS v FROM points, (SELECT DISTINCT batch AS cls FROM points) c", _SPREAD, 12),
)

# ---- graphs, ontologies --------------------------------------------------------------------------------------------

_SHARED = "SELECT x.id AS src, y.id AS dst, count(*) AS s FROM (SELECT id, nbr FROM nn UNION ALL SELECT DISTINCT id, id FROM nn) x JOIN (SELECT id, nbr FROM nn UNION ALL SELECT DISTINCT id, id FROM nn) y ON x.nbr = y.nbr AND x.id <> y.id GROUP BY 1, 2"
ORACLE_SQL["connected_components"] = sql(f", links AS MATERIALIZED (SELECT src, dst FROM ({_SHARED}) z WHERE s / (22.0 - s) >= 0.3), reach AS (SELECT src AS id, src AS r FROM links UNION SELECT reach.id, dst FROM reach JOIN links ON src = r) SELECT id, min(r) AS component FROM reach GROUP BY 1", "nn").replace("WITH ", "WITH RECURSIVE ", 1).replace(") , links", "), links")
ORACLE_SQL["sign_groups"] = sql(", pos AS MATERIALIZED (SELECT col_a AS a, col_b AS b FROM mp GROUP BY 1, 2 HAVING corr(a, b) > 0), both_ AS (SELECT a, b FROM pos UNION ALL SELECT b, a FROM pos), reach AS (SELECT min(col) AS id FROM m UNION SELECT b FROM reach JOIN both_ ON a = id) SELECT col AS id, CASE WHEN col IN (SELECT id FROM reach) THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT col FROM m) c", "mp").replace("WITH ", "WITH RECURSIVE ", 1).replace(") , pos", "), pos")
_LEVELS = "lev AS (SELECT term, CAST(max(level) AS INTEGER) AS level FROM (WITH RECURSIVE down AS (SELECT DISTINCT parent AS term, 0 AS level FROM onto WHERE parent NOT IN (SELECT child FROM onto) UNION SELECT child, level + 1 FROM down JOIN onto ON parent = term) SELECT * FROM down) d GROUP BY 1)"
ORACLE_SQL["ontology_levels"] = sql(f", {_LEVELS} SELECT * FROM lev", "onto").replace(") , lev", "), lev")


def _elimination() -> str:
    parts = [_LEVELS, "closed AS MATERIALIZED (SELECT DISTINCT term, ancestor FROM up)", "hit AS (SELECT c_custkey AS gene FROM customer WHERE c_acctbal > 7000)"]
    parts += ["nk AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal > 7000) AS k FROM customer)"]
    genes = "SELECT DISTINCT term, gene FROM (SELECT unnest(['world', r_name, n_name, n_name || '/' || c_mktsegment]) AS term, c_custkey AS gene FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) t"
    for level in (3, 2, 1, 0):
        parts.append(f"g{level} AS MATERIALIZED ({genes})")
        parts.append(f"now{level} AS MATERIALIZED (SELECT term, gene FROM g{level} JOIN lev USING (term) WHERE level = {level})")
        p = hypergeometric("greatest(hits - 1, 0)", "size", "n", "k")
        parts.append(f"res{level} AS MATERIALIZED (SELECT term, {level} AS level, hits, size, {p} AS p FROM (SELECT term, count(*) AS size, count(hit.gene) AS hits FROM now{level} LEFT JOIN hit USING (gene) GROUP BY 1 HAVING count(*) >= 5) c, nk)")
        gone = f"SELECT ancestor, gene FROM now{level} JOIN closed USING (term) WHERE term <> ancestor AND term IN (SELECT term FROM res{level} WHERE p <= 0.01)"
        genes = f"SELECT * FROM g{level} WHERE (term, gene) NOT IN ({gone})"
    every = " UNION ALL ".join(f"SELECT * FROM res{level}" for level in (3, 2, 1, 0))
    return f"{_CLOSURE}, {', '.join(parts)} SELECT term, CAST(level AS INTEGER) AS level, CAST(hits AS BIGINT) AS hits, CAST(size AS BIGINT) AS size, round(p, 9) AS p, round(fdr, 9) AS fdr FROM ({with_fdr(every)}) e"


ORACLE_SQL["ontology_elimination"] = _elimination()

# ---- enrichment, tests ---------------------------------------------------------------------------------------------

_EDGE = f"""SELECT *, max(top) OVER s AS hi, min(bottom) OVER s AS lo, arg_max(pos, bottom) OVER s AS up, arg_min(pos, bottom) OVER s AS down FROM (
    SELECT *, cum - (pos - i) / CAST(n - size AS DOUBLE) AS top, cum - (pos - i) / CAST(n - size AS DOUBLE) - x AS bottom FROM (
    SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY pos) AS i, sum(x) OVER (PARTITION BY set_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM (
    SELECT *, abs(stat) / sum(abs(stat)) OVER (PARTITION BY set_id) AS x FROM ({_HITS}) h) y) z) t WINDOW s AS (PARTITION BY set_id)"""
put(
    "leading_edges",
    f"SELECT set_id, CAST(any_value(size) AS BIGINT) AS size, round(CASE WHEN any_value(hi) > -any_value(lo) THEN any_value(hi) WHEN any_value(hi) < -any_value(lo) THEN any_value(lo) ELSE 0 END, 6) AS es, string_agg(CAST(gene AS VARCHAR), ',' ORDER BY gene) FILTER (WHERE CASE WHEN hi > -lo THEN pos <= up WHEN hi < -lo THEN pos >= down ELSE false END) AS leading_edge FROM ({_EDGE}) e GROUP BY 1",
    ("ranked", "sets"),
)
_ORA = "SELECT set_id, h AS hits, m AS size, (h * (n - m - k + h)) / CAST((k - h) * (m - h) AS DOUBLE) AS odds, " + hypergeometric("greatest(h - 1, 0)", "m", "n", "k") + " AS p FROM (SELECT set_id, count(*) AS m, count(*) FILTER (WHERE gene IN (SELECT p_partkey FROM part WHERE p_size <= 7)) AS h, any_value(n) AS n, any_value(k) AS k FROM sets, (SELECT count(*) AS n, count(*) FILTER (WHERE p_size <= 7) AS k FROM part) c GROUP BY 1) z"
put("over_representation_pvalues", f"SELECT set_id, CAST(hits AS BIGINT) AS hits, CAST(size AS BIGINT) AS size, round(odds, 6) AS odds, round(p, 9) AS p, round(fdr, 9) AS fdr FROM ({with_fdr(_ORA)}) e", ("sets",))
put("z_pvalues", f"SELECT gene, round(stat * 10, 9) AS z, round({two_sided('(stat * 10)')}, 9) AS p FROM stats", ("stats",))
_FISHER = "(0.5 * ln((1 + r_a) / (1 - r_a)) - 0.5 * ln((1 + r_b) / (1 - r_b))) / sqrt(1.0 / (n_a - 3) + 1.0 / (n_b - 3))"
put(
    "differential_correlation_pvalues",
    f"SELECT col_a, col_b, round(r_a, 6) AS r_a, round(r_b, 6) AS r_b, round(z, 6) AS z, round({two_sided('z')}, 6) AS p FROM (SELECT *, {_FISHER} AS z FROM (SELECT col_a, col_b, corr(a, b) FILTER (WHERE p_brand < 'Brand#33') AS r_a, corr(a, b) FILTER (WHERE p_brand >= 'Brand#33') AS r_b, count(*) FILTER (WHERE p_brand < 'Brand#33') AS n_a, count(*) FILTER (WHERE p_brand >= 'Brand#33') AS n_b FROM mp JOIN part ON p_partkey = mp.row GROUP BY 1, 2) c) d",
    ("mp",),
)
_KBET = "SELECT g.id, sum((coalesce(n, 0) - 10 * share) * (coalesce(n, 0) - 10 * share) / (10 * share)) AS chi2, (count(*) - 1) / 2.0 AS half FROM (SELECT DISTINCT id FROM nn) g CROSS JOIN (SELECT batch, count(*) / CAST((SELECT count(*) FROM points) AS DOUBLE) AS share FROM points GROUP BY 1) s LEFT JOIN (SELECT nn.id, batch, count(*) AS n FROM nn JOIN points ON points.id = nbr GROUP BY nn.id, batch) c ON c.id = g.id AND c.batch = s.batch GROUP BY 1"
put("kbet_pvalues", f"SELECT id, round(chi2, 6) AS chi2, round(1 - ({gamma_p('half', '(chi2 / 2.0)')}), 6) AS p FROM ({_KBET}) k", ("nn",))


def _mann_whitney() -> str:
    """The oracle of the test's statistics, its z unrounded, with p and fdr."""
    head, body = ORACLE_SQL["dge_mann_whitney"].split(" SELECT gene, round(k1", 1)
    inner = "SELECT gene, k1 / n1 AS share_1, k2 / n2 AS share_2, s1 / n1 - s2 / n2 AS lfc, (r1 + (n1 - k1) * (1 + n0) / 2.0 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) AS z FROM (" + body.split("AS z FROM (", 1)[1]
    return f"{head} SELECT gene, round(share_1, 6) AS share_1, round(share_2, 6) AS share_2, round(lfc, 6) AS lfc, round(z, 6) AS z, round(p, 6) AS p, round(fdr, 6) AS fdr FROM ({with_fdr(f'SELECT *, {two_sided("z")} AS p FROM ({inner}) u')}) e"


ORACLE_SQL["dge_pvalues"] = _mann_whitney()

# ---- autocorrelation -----------------------------------------------------------------------------------------------

_SPATIAL = (
    ("umi", "SELECT cell, CAST(sum(raw) AS DOUBLE) AS umi FROM counts GROUP BY 1"),
    ("near", "SELECT id, nbr, dist FROM (SELECT id, nbr, dist, row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), nbr) AS r FROM (SELECT x.c_custkey AS id, y.c_custkey AS nbr, sqrt((x.c_acctbal - y.c_acctbal) ** 2 + ((x.c_nationkey - y.c_nationkey) * 100.0) ** 2) AS dist FROM customer x JOIN customer y ON x.c_custkey <> y.c_custkey WHERE x.c_custkey IN (SELECT cell FROM umi) AND y.c_custkey IN (SELECT cell FROM umi)) d) r WHERE r <= 8"),
    ("wt", "SELECT least(id, nbr) AS src, greatest(id, nbr) AS dst, sum(w) AS w FROM (SELECT id, nbr, CASE WHEN last = 0 THEN 1.0 ELSE exp(-dist * dist / (last * last)) END AS w FROM (SELECT *, max(dist) OVER (PARTITION BY id) AS last FROM near) a) b GROUP BY 1, 2"),
    ("dg", "SELECT cell, sum(w) AS d FROM (SELECT src AS cell, w FROM wt UNION ALL SELECT dst, w FROM wt) u GROUP BY 1"),
    ("grid", "SELECT g.gene, u.cell, u.umi, coalesce(c.raw, 0) AS raw FROM (SELECT DISTINCT gene FROM counts) g CROSS JOIN umi u LEFT JOIN counts c ON c.gene = g.gene AND c.cell = u.cell"),
)
_LOCAL = f"""SELECT gene, g, c, z, {greater("z")} AS p FROM (SELECT gene, g, g / top AS c, g / (SELECT sqrt(sum(w * w)) FROM wt) AS z FROM
    (SELECT a.gene, sum(w * a.x * b.x) AS g FROM wt JOIN xs a ON a.cell = src JOIN xs b ON b.cell = dst AND b.gene = a.gene GROUP BY 1) n JOIN
    (SELECT gene, sum(d * x * x) / 2 AS top FROM xs JOIN dg USING (cell) GROUP BY 1) t USING (gene)) q"""
_AUTO = f"SELECT gene, round(g, 6) AS g, round(c, 6) AS c, round(z, 6) AS z, round(p, 6) AS p, round(fdr, 6) AS fdr FROM ({with_fdr(_LOCAL)}) e"
_DANB = (
    ("mom", "SELECT gene, sum(raw) AS s, sum((raw - mu) * (raw - mu)) / (count(*) - 1) AS v, any_value(s_) * any_value(s_) * any_value(q) / count(*) AS x, any_value(s_) / count(*) AS m FROM (SELECT gene, raw, s_ * umi / t AS mu, s_, q FROM grid JOIN (SELECT gene, CAST(sum(raw) AS DOUBLE) AS s_ FROM counts GROUP BY 1) z USING (gene), (SELECT sum(umi) AS t, sum(umi * umi) / (sum(umi) * sum(umi)) AS q FROM umi) w) y GROUP BY 1"),
    ("xs", "SELECT gene, cell, coalesce((raw - mu) / sqrt(mu * (1 + mu / size)), 0) AS x FROM (SELECT grid.gene, cell, raw, s * umi / (SELECT sum(umi) FROM umi) AS mu, CASE WHEN v = m OR x / (v - m) < 0 THEN 1e9 ELSE greatest(x / (v - m), 1e-10) END AS size FROM grid JOIN mom USING (gene)) y"),
)
put("gene_autocorrelation", _AUTO, ("counts",), *_SPATIAL, *_DANB)
_BERN = (
    ("bin", "SELECT cell, floor((row_number() OVER (ORDER BY umi, cell) - 1) * 30 / count(*) OVER ()) AS b, log10(umi) AS lu FROM umi"),
    ("line", "SELECT gene, coalesce(regr_slope(ln(p / (1 - p)), c), 0) AS s, regr_intercept(ln(p / (1 - p)), c) AS i FROM (SELECT gene, b, (count(*) FILTER (WHERE raw > 0) + 1.0) / (count(*) + 2) AS p, avg(lu) AS c FROM grid JOIN bin USING (cell) GROUP BY 1, 2) y GROUP BY 1"),
    ("xs", "SELECT gene, cell, ((CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END) - p) / sqrt(p * (1 - p)) AS x FROM (SELECT gene, cell, raw, 1 / (1 + exp(-(i + s * lu))) AS p FROM grid JOIN bin USING (cell) JOIN line USING (gene)) y"),
)
put("gene_autocorrelation_bernoulli", _AUTO, ("counts",), *_SPATIAL, *_BERN)

# ---- sources -------------------------------------------------------------------------------------------------------

_PARTS = "SELECT CAST(cell % 2 AS INTEGER) AS part, cell AS old_cell, gene, raw FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING count(*) >= 10)"
put("combined_sources", f"SELECT i.cell, gene, raw, p.part, p.old_cell FROM ({_PARTS}) p JOIN (SELECT part, old_cell, row_number() OVER (ORDER BY part, old_cell) - 1 AS cell FROM ({_PARTS}) q GROUP BY 1, 2 HAVING count(*) >= 10 AND sum(raw) >= 100) i ON i.part = p.part AND i.old_cell = p.old_cell", ("counts",))


# ---- variable genes ------------------------------------------------------------------------------------------------


def _variable(cells: str, most: int | None = None) -> list[tuple[str, str]]:
    """Steps to var_std(batch, gene, mean, var, expected, var_std): local parabolas by weighted normal equations."""
    order, few = (", row_number() OVER (PARTITION BY batch, gene ORDER BY d, i) AS r", f" WHERE r <= {most}") if most else ("", "")
    return [
        ("own", cells),
        ("size", "SELECT batch, CAST(count(*) AS DOUBLE) AS n FROM own GROUP BY 1"),
        ("mv", "SELECT batch, gene, n, sum(raw) / n AS mean, sum(CAST(raw AS DOUBLE) * raw) / n - (sum(raw) / n) * (sum(raw) / n) AS var FROM counts JOIN own USING (cell) JOIN size USING (batch) GROUP BY batch, gene, n"),
        ("pts", "SELECT *, row_number() OVER (PARTITION BY batch ORDER BY x, gene) - 1 AS i, least(count(*) OVER (PARTITION BY batch), greatest(CAST(ceil(0.3 * count(*) OVER (PARTITION BY batch)) AS BIGINT), 3)) AS k FROM (SELECT batch, gene, n, mean, var, log10(mean) AS x, log10(var) AS y FROM mv WHERE var > 0) v"),
        ("ends", "SELECT a.batch, a.x AS l, b.x AS r FROM pts a JOIN pts b ON b.batch = a.batch AND b.i = a.i + a.k"),
        ("win", "SELECT p.batch, p.gene, count(*) FILTER (WHERE p.x - l > r - p.x) AS lo FROM pts p LEFT JOIN ends e ON e.batch = p.batch GROUP BY 1, 2"),
        ("near", f"SELECT *, max(d) OVER (PARTITION BY batch, gene) AS reach{order} FROM (SELECT p.batch, p.gene, q.i, q.y, q.x - p.x AS dx, abs(q.x - p.x) AS d FROM pts p JOIN win USING (batch, gene) JOIN pts q ON q.batch = p.batch AND q.i >= lo AND q.i < lo + p.k) z"),
        ("eq", f"SELECT batch, gene, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4, sum(w * y) AS b0, sum(w * u * y) AS b1, sum(w * u * u * y) AS b2 FROM (SELECT batch, gene, y, dx / reach AS u, pow(greatest(1 - pow(d / reach, 3), 0), 3) AS w FROM near{few}) z GROUP BY 1, 2"),
        ("fit", "SELECT batch, gene, pow(10, (b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))) AS expected FROM eq"),
        ("var_std", "SELECT batch, gene, mean, var, expected, (q + (n - k) * z0 * z0) / n - pow((s + (n - k) * z0) / n, 2) AS var_std FROM (SELECT batch, gene, n, mean, var, expected, z0, sum(z) AS s, sum(z * z) AS q, count(*) AS k FROM (SELECT p.batch, p.gene, n, mean, var, expected, greatest(least((raw - mean) / sqrt(expected), sqrt(n)), -sqrt(n)) AS z, greatest(least(-mean / sqrt(expected), sqrt(n)), -sqrt(n)) AS z0 FROM pts p JOIN fit USING (batch, gene) JOIN own ON own.batch = p.batch JOIN counts c ON c.cell = own.cell AND c.gene = p.gene) a GROUP BY ALL) b"),
    ]


_ALL = "round(mean, 4) AS mean, round(var, 4) AS var, round(expected, 4) AS expected, round(var_std, 4) AS var_std FROM var_std"
_EVERY = "SELECT c_custkey AS cell, 0 AS batch FROM customer"
put("variable_genes", f"SELECT gene, {_ALL}", ("counts",), *_variable(_EVERY))
put("variable_genes_by_batch", f"SELECT batch, gene, {_ALL}", ("counts",), *_variable("SELECT c_custkey AS cell, r_name AS batch FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"))
put("selected_genes", "SELECT gene FROM (SELECT gene, row_number() OVER (ORDER BY var_std DESC, gene) AS r, count(*) OVER () AS n FROM var_std) v WHERE r <= ceil(n * round(1 - 0.85, 9))", ("counts",), *_variable(_EVERY, 64))


# ---- motifs --------------------------------------------------------------------------------------------------------

put(
    "motif_enrichment",
    """SELECT motif, round(auc, 9) AS auc, round(nes, 6) AS nes, CAST(top AS INTEGER) AS rank_at_max, CAST(count(gene) AS INTEGER) AS n_genes, coalesce(string_agg(CAST(gene AS VARCHAR), ',' ORDER BY gene), '') AS leading_edge
    FROM best LEFT JOIN (SELECT motif AS m, gene, rank FROM hits) h ON m = motif AND rank <= top GROUP BY motif, auc, nes, top""",
    ("counts",),
    ("mr", "SELECT cell AS motif, gene, row_number() OVER (PARTITION BY cell ORDER BY raw DESC, gene) AS rank FROM counts"),
    ("own", "SELECT DISTINCT p_partkey AS gene FROM part WHERE p_brand = 'Brand#11'"),
    ("hits", "SELECT motif, gene, rank FROM mr JOIN own USING (gene) WHERE rank > 0 AND rank < 50"),
    ("aucs", "SELECT m.motif, coalesce(a, 0) / CAST(30 * (SELECT count(*) FROM own) AS DOUBLE) AS auc FROM (SELECT DISTINCT motif FROM mr) m LEFT JOIN (SELECT motif, sum((nxt - rank) * i) AS a FROM (SELECT motif, rank, row_number() OVER w AS i, coalesce(lead(rank) OVER w, 30) AS nxt FROM hits WHERE rank < 30 WINDOW w AS (PARTITION BY motif ORDER BY rank, gene)) z GROUP BY 1) y USING (motif)"),
    ("strong", "SELECT * FROM (SELECT motif, auc, (auc - avg(auc) OVER ()) / stddev_samp(auc) OVER () AS nes FROM aucs) z WHERE nes >= 0.5 AND motif IN (SELECT motif FROM hits)"),
    ("curve", "SELECT h.motif, r.i AS top, count(*) FILTER (WHERE h.rank <= r.i) AS c FROM hits h CROSS JOIN range(0, 50) r(i) GROUP BY 1, 2"),
    ("lim", "SELECT top, s / n + 2 * sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS lim FROM (SELECT top, CAST(sum(c) AS DOUBLE) AS s, CAST(sum(c * c) AS DOUBLE) AS q, (SELECT count(DISTINCT motif) FROM mr) AS n FROM curve GROUP BY 1) z"),
    ("best", "SELECT motif, auc, nes, top FROM (SELECT motif, auc, nes, top, row_number() OVER (PARTITION BY motif ORDER BY c - lim DESC, top) AS r FROM strong JOIN curve USING (motif) JOIN lim USING (top)) z WHERE r = 1"),
)


# ---- trees ---------------------------------------------------------------------------------------------------------

put(
    "tree_root_splits",
    """SELECT CAST(batch AS INTEGER) AS batch, tf, CAST(bin AS INTEGER) AS bin, round(gain, 6) AS gain, n, n_right FROM (
    SELECT *, row_number() OVER (PARTITION BY batch ORDER BY round(gain, 9) DESC, tf, bin) AS i_ FROM tried) z WHERE i_ = 1 AND gain > 1e-9""",
    ("norm",),
    ("everyone", "SELECT count(*) AS n FROM customer"),
    ("ends", "SELECT gene, least(min(norm), CASE WHEN count(*) < any_value(n) THEN 0 ELSE min(norm) END) AS lo, max(norm) AS hi FROM norm JOIN part ON gene = p_partkey, everyone WHERE p_size = 1 GROUP BY 1"),
    ("q", "SELECT cell, gene AS tf, round((norm - lo) * 255 / (hi - lo)) AS bin FROM norm JOIN ends USING (gene) WHERE hi > lo AND round((norm - lo) * 255 / (hi - lo)) > 0"),
    ("cuts", "SELECT x.tf, x.bin, count(*) AS n_right FROM (SELECT DISTINCT tf, bin FROM q) x JOIN q y ON x.tf = y.tf AND y.bin >= x.bin GROUP BY 1, 2"),
    ("goal", "SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS batch, gene, sum(norm) AS s FROM norm JOIN part ON gene = p_partkey GROUP BY 1, 2"),
    ("went", "SELECT x.tf, x.bin, gene, sum(norm) AS r FROM (SELECT DISTINCT tf, bin FROM q) x JOIN q y ON x.tf = y.tf AND y.bin >= x.bin JOIN norm ON norm.cell = y.cell GROUP BY 1, 2, 3"),
    (
        "tried",
        "SELECT batch, tf, bin, n, n_right, sum(coalesce(r, 0) ** 2 / n_right + (s - coalesce(r, 0)) ** 2 / (n - n_right) - s ** 2 / n) AS gain "
        "FROM goal CROSS JOIN cuts CROSS JOIN everyone LEFT JOIN went USING (tf, bin, gene) WHERE n_right >= 2 AND n - n_right >= 2 GROUP BY 1, 2, 3, 4, 5",
    ),
)


# ---- matching and communities --------------------------------------------------------------------------------------

#: Rounds written out; the queries end earlier, and further rounds change nothing.
MATCHED, MOVED = 16, 30
_PRIME = "1000003"
_GRAPH = ("graph", "SELECT lo AS src, hi AS dst, w FROM (SELECT least(id, nbr) AS lo, greatest(id, nbr) AS hi, CAST(count(*) AS DOUBLE) AS w FROM nn GROUP BY 1, 2) z UNION ALL SELECT hi, lo, CAST(count(*) AS DOUBLE) FROM (SELECT least(id, nbr) AS lo, greatest(id, nbr) AS hi FROM nn) z GROUP BY 1, 2")


def matched(graph: str) -> list[tuple[str, str]]:
    """Rounds of mutual heaviest edges: mutual0.., and mates (id, mate)."""
    mixed = f"((least(src, dst) % {_PRIME}) * 7919 + (greatest(src, dst) % {_PRIME}) * 104729) % {_PRIME}"
    steps = [("free0", f"SELECT src, dst, sum(w) AS w FROM {graph} WHERE src <> dst GROUP BY 1, 2")]
    for i in range(MATCHED):
        steps.append((f"pick{i}", f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, {mixed}, least(src, dst), dst) AS r FROM free{i}) z WHERE r = 1"))
        steps.append((f"mutual{i}", f"SELECT a.src AS id, a.dst AS mate FROM pick{i} a JOIN pick{i} b ON a.src = b.dst AND a.dst = b.src"))
        steps.append((f"free{i + 1}", f"SELECT * FROM free{i} WHERE src NOT IN (SELECT id FROM mutual{i}) AND dst NOT IN (SELECT id FROM mutual{i})"))
    every = " UNION ALL ".join(f"SELECT * FROM mutual{i}" for i in range(MATCHED))
    return [*steps, ("mates", f"SELECT id, coalesce(mate, id) AS mate FROM (SELECT DISTINCT src AS id FROM {graph}) n LEFT JOIN ({every}) m USING (id)")]


put("edge_matching", "SELECT * FROM mates", ("und",), *matched("und"))
put(
    "coarse_graph",
    "SELECT least(a.id, a.mate) AS src, least(b.id, b.mate) AS dst, sum(w) AS w FROM graph JOIN mates a ON a.id = src JOIN mates b ON b.id = dst WHERE least(a.id, a.mate) <> least(b.id, b.mate) GROUP BY 1, 2",
    ("nn",),
    _GRAPH,
    *matched("graph"),
)


def moved(graph: str) -> list[tuple[str, str]]:
    """Rounds of synchronous modularity moves: l0.. hold (id, community)."""
    steps = [("k", f"SELECT src AS id, sum(w) AS k FROM {graph} GROUP BY 1"), ("l0", "SELECT id, id AS community FROM k")]
    for i in range(MOVED):
        gain = "round(into_ - k * (size - CASE WHEN x.community = l.community THEN k ELSE 0 END) / (SELECT sum(k) FROM k), 9)"
        tried = (
            f"SELECT x.id, l.community AS own, x.community AS want, {gain} AS gain FROM (SELECT src AS id, community, sum(w) AS into_ FROM {graph} JOIN l{i} q ON q.id = dst WHERE src <> dst GROUP BY 1, 2) x "
            f"JOIN l{i} l ON l.id = x.id JOIN k ON k.id = x.id JOIN (SELECT community, sum(k) AS size FROM l{i} JOIN k USING (id) GROUP BY 1) s ON s.community = x.community"
        )
        mixed = lambda x, i=i: f"((({x} % {_PRIME}) + 1) * {7919 + 2 * i + 1}) % {_PRIME}"
        steps.append((f"wish{i}", f"SELECT id, own, want FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, want) AS r FROM ({tried}) t WHERE gain > 0) z WHERE r = 1 AND want <> own"))
        steps.append((f"later{i}", f"SELECT DISTINCT src AS id FROM {graph} JOIN wish{i} a ON a.id = src JOIN wish{i} b ON b.id = dst WHERE src <> dst AND (b.own = a.want OR b.want = a.own) AND ({mixed('dst')} < {mixed('src')} OR ({mixed('dst')} = {mixed('src')} AND dst < src))"))
        steps.append((f"l{i + 1}", f"SELECT l.id, coalesce(w.want, l.community) AS community FROM l{i} l LEFT JOIN (SELECT id, want FROM wish{i} WHERE id NOT IN (SELECT id FROM later{i})) w USING (id)"))
    return steps


put("louvain", f"SELECT id, min(id) OVER (PARTITION BY community) AS community FROM l{MOVED}", ("nn",), _GRAPH, *moved("graph"))


# ---- h5ad ----------------------------------------------------------------------------------------------------------

for _name in ("h5ad_files", "h5ad_normalised_files"):
    put(
        _name,
        "SELECT cell, gene, raw FROM known WHERE cell IN (SELECT cell FROM known GROUP BY 1 HAVING count(*) >= 10 AND sum(raw) >= 100)",
        ("counts",),
        ("known", "SELECT * FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING count(*) >= 10)"),
    )


put("knn_saved_index", "SELECT id, rank, nbr, round(dist, 9) AS dist FROM nn", ("nn",))
