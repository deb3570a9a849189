"""The pipeline, stage by stage."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from helixframe.llm import queries


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "best_fit_packing"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, at, sf)
        assert new.columns == columns and new.dtypes == docs.dtypes, name
        new = corpus_pipeline.materialise(new)
        assert new.count() <= at.count()
        assert new.join(at, "doc_id", "left_anti").count() == 0
        at = new
    assert at.groupBy("doc_id").count().where("count > 1").isEmpty()
    assert at.where(F.length("text") != F.col("n_chars")).isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert packed.select("doc_id").distinct().count() == at.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == packed.count()


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    key = "vec_id" if name.startswith("op9") else "doc_id"
    want = spark.read.parquet(f"{sf}/{'embeddings' if key == 'vec_id' else 'documents'}.parquet").count()
    assert df.select(key).distinct().count() == want


ODD = [(9001, None), (9002, ""), (9003, " \t"), (9004, "one"), (9005, "word " * 20_000), (9006, "repeated row of some words"), (9006, "repeated row of some words"), (9007, "repeated row of some words"), (None, "no id here at all"), (9008, "write to zanzibarski at secret@place.org about it")]


def _tables(spark, sf, at, docs):
    docs.write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return str(at)


def test_odd_rows_and_clashing_columns(spark, sf, tmp_path):
    """Each stage's decisions against plain Python, on a table with odd rows and columns named like results."""
    from collections import Counter

    from test_text_operators import ALNUM, components, lower, shingles

    from helixframe.llm import pii, toxicity

    d = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.length("text").cast("long").alias("n_chars"))
    d = d.select("doc_id", "text", "lang", "source", "n_chars").union(odd)
    d = d.selectExpr("*", "'a' as th", "2 as score", "'b' as found", "3 as component_id", "4 as kept", "5 as n_hit", "6 as spans", "7 as length", "8 as piece", "9 as label", "10 as tl", "11 as clean")
    at = _tables(spark, sf, tmp_path / "t", d)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    known = lambda df: Counter((str(r.doc_id), r.text) for r in df.select("doc_id", "text").collect())
    stages, labels = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{at}/labels.parquet")

    score = {(str(r.doc_id), r.text): r.score for r in toxicity.score(docs, labels).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect()}
    one = corpus_pipeline.materialise(stages["toxicity"](spark, docs, at))
    assert known(one) == Counter({k: n for k, n in known(docs).items() if score[k] < 0.3})

    two = corpus_pipeline.materialise(stages["near_dedup"](spark, one, at))
    sets = {int(i): shingles(t) for i, t in known(one) if i != "None"}
    comp = components(sets)
    assert set(known(two)) == {(i, t) for i, t in known(one) if i == "None" or comp[int(i)] == int(i)} and max(known(two).values()) == 1

    three = corpus_pipeline.materialise(stages["decontamination"](spark, two, at))
    windows = set()
    for r in spark.read.parquet(f"{at}/benchmark.parquet").collect():
        w = ALNUM.findall(lower(r.text))
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    bad = lambda t: any(tuple(w[j : j + n]) in windows for w in [ALNUM.findall(lower(t))] for n in sizes for j in range(len(w) - n + 1))
    assert set(known(three)) == {(i, t) for i, t in known(two) if not bad(t)}

    four = corpus_pipeline.materialise(stages["pii"](spark, three, at))
    names = [f"[{k.upper()}]" for k in (*pii.KINDS, "term")]
    marks = {str(r.doc_id): sorted((s.start, s.end, s.kind) for s in r.found) for r in pii.spans(three).collect()}
    want = Counter()
    for i, t in known(three):
        out, pos = "", 0
        for a, b, k in marks[i]:
            if a >= pos:
                out += (t or "")[pos:a] + names[k]
            pos = max(pos, b)
        want[(i, out + t[pos:] if t is not None else None)] += 1
    assert known(four) == want and "secret@place.org" not in " ".join(t or "" for _, t in known(four))
    for df in (one, two, three, four):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    packed = corpus_pipeline.run(spark, at)
    assert {str(r[0]) for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in known(four)}


def test_pipeline_of_nothing(spark, sf, tmp_path):
    at = _tables(spark, sf, tmp_path / "t", spark.read.parquet(f"{sf}/documents.parquet").where("false"))
    assert corpus_pipeline.run(spark, at).count() == 0
