"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import decontam, embeddings, fim, lattice, license, neardup, packing, pii, quality, repeats, resample, sharding, toxicity
from helixframe.llm._common import table
from helixframe.llm._labels import remainder


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op4_automaton_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def op5_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(table(spark, sf_dir, "documents"))


def op6_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))


def op9_rotation_code_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_best_fit_packing,
        op3_factorisation_quality,
        op4_automaton_toxicity,
        op5_lattice_scores,
        op6_setsketch_near_dedup,
        op7_license_signatures,
        op8_hypergeometric_sharding,
        op9_rotation_code_near_vectors,
        op10_disclosure_pii,
        op11_fill_in_middle,
        op12_importance_resampling,
        op13_substring_dedup,
    )
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

#: The queries that SQL can express whole. Learned scores, tokenisation, random draws and hundreds of regular expressions
#: have none; tests hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS x, CAST(least(len(w), 10) AS BIGINT) AS n
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0) z),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
    FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes) z),
hits AS (SELECT doc_id, i, places.n, item FROM places JOIN windows ON places.x = windows.x AND places.n = windows.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) z GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) z GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_setsketch_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format("text")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS x
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) z),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(r) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
    "op9_rotation_code_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.l * y.l) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM (SELECT id AS vec_id, min(r) AS component_id FROM reach GROUP BY 1) c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) k USING (vec_id)""",
    "op11_fill_in_middle": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p""",
    "op12_importance_resampling": f"""
WITH crc AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) ORDER BY b) AS tab FROM range(256) t(b)),
d AS (SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents),
b AS (SELECT {_ALNUM.format("text")} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
fs AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf) z),
hashed AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda r, c: xor(r >> 8, tab[(xor(r, c) & 255) + 1])), 4294967295) % 10000 AS bucket FROM fs, crc),
s AS (SELECT bucket, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY 1),
gain AS (SELECT k.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s)::DOUBLE + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS g
    FROM (SELECT DISTINCT bucket FROM hashed) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
summed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS total FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(greatest(0, 2 * len(w) - 1) AS BIGINT) AS n_features, len(w) >= 20 AS enough,
    CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % (2 * len(w) - 1)) + (2 * len(w) - 1)) % (2 * len(w) - 1)) // (2 * len(w) - 1) END AS weight,
    CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN summed USING (doc_id)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE enough)
SELECT z.doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM r) THEN rank END AS rank
FROM z LEFT JOIN r USING (doc_id)""",
    "op13_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d) z),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM x) z WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
marks AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) z ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
