"""Fill-in-middle, resampling and substring dedup against brute force, with the odd rows that tables hold."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import fim, repeats, resample
from helixframe.llm._text import ALNUM as ALNUM_BYTES, text_words

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"Shared{i % 7}é passage{i}" for i in range(30))
LONG = " ".join(f"w{i * i % 991}" for i in range(9000))
ODD = [
    (9001, None),
    (9002, ""),
    (9003, " \t\n"),
    (9004, "one"),
    (9005, "holds <P> a marker"),
    (9006, "almost <P a <S < M> <<M"),
    (9007, "<S>"),
    (9008, "x" * 70_000),
    (9009, "repeated row of few words"),
    (9009, "repeated row of few words"),
    (9009, "same id, other words"),
    (9010, "É è 😀 日本語 ß " * 30),
    (9011, LONG),
    (9012, LONG + " tail"),
    (9013, PASSAGE),
    (9014, "before it " + PASSAGE.replace(" ", "\n\t") + " and after"),
    (9015, PASSAGE.lower() + " " + PASSAGE),
    (9016, "same " * 36),
    (9017, "again " * 35),
    (9018, ("日本語 <" * 12_000)),
    (9019, " ".join(["y" * 300] * 40)),
    (None, "no id here at all, but quite " + PASSAGE),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The smallest documents and odd rows, with extra columns whose names clash with results."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    return d.select(F.lit(1).alias("score"), "doc_id", F.lit("a").alias("n"), "text", F.lit("x").alias("n_words"), F.lit("y").alias("key"), F.lit(2).alias("rid"), F.lit(3).alias("unit"), F.lit("z").alias("form")).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def fim_by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("sizes", [{}, {"giant": 40, "chunk": 13}, {"giant": 1000, "chunk": 400}])
def test_fill_in_middle_whole_and_in_chunks(docs, rows, sizes):
    made = fim.fill_in_middle(docs, **sizes).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made]
    assert sorted(map(repr, got)) == sorted(repr(fim_by_hand(*r)) for r in rows)
    assert sorted((repr(r.doc_id), r.restored) for r in made) == sorted((repr(i), t or "") for i, t in rows)


def test_scan_functions_compose_like_the_automaton():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["<", "P", "S", "M", ">", "ab", "é", " ", "😀", "<P>"]) for _ in range(rng.randrange(400))).encode()
        cut = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        parts = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]
        scan = fim.Scan(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        totals = scan.totals()
        for start in range(4):
            state, units, marks = start, 0, 0
            whole = [start, 0, 0]
            for i in range(len(parts)):
                units, marks, state = units + totals[i, state], marks + totals[i, state + 4], int(fim.FUNCTIONS[scan.function[i], state])
            for byte in text:
                c = fim.CLASS[byte]
                whole = [int(fim.NEXT[whole[0], c]), whole[1] + int(fim.UNIT[whole[0], c]), whole[2] + int(fim.MARK[whole[0], c])]
            assert [state, units, marks] == whole


def test_registers_are_crc32():
    texts = ["a b", "É è 😀 " + "x" * 300 + " y " + "z" * 128 + " " + "q" * 129, "", "one"]
    w = text_words(texts, ALNUM_BYTES)
    one, two = resample.features(w, 10_000)
    words = [x for t in texts for x in ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    assert one.tolist() == [zlib.crc32(x.encode()) % 10_000 for x in words]
    pairs = [p for t in texts for x in [ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))] for p in [*(f"{a} {b}" for a, b in zip(x, x[1:], strict=False)), *([None] if x else [])]]
    assert two.tolist() == [-1 if p is None else zlib.crc32(p.encode()) % 10_000 for p in pairs]


def grams(text):
    w = ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def test_resample_against_brute_force(docs, rows, spark, sf):
    target = spark.read.parquet(f"{sf}/benchmark.parquet").select("text")
    s, t = Counter(b for _, x in rows for b in grams(x)[1]), Counter(b for r in target.collect() for b in grams(r.text)[1])
    more, less = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    want = []
    for i, text in rows:
        w, found = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * more / ((s[b] + 1) * less))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha("7:" + ("" if i is None else str(i)))[:8], 16)
        want.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= 20))
    able = sorted((x for x in want if x[4]), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))[: 25 * sum(x[4] for x in want) // 100]
    rank = {x: k for k, x in enumerate(able, 1)}
    got = [tuple(r) for r in resample.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(map(repr, got)) == sorted(repr((*x[:4], rank.get(x))) for x in want)


def left_by_hand(rows, k):
    texts = [SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[j : j + k]) for w in texts for j in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {p for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for p in range(j, j + k)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("how", [{}, {"stripe_windows": 256}, {"window": 3, "stripe_windows": 4096, "giant": 500}, {"window": 1}])
def test_repeats_against_brute_force(docs, rows, how):
    got = [tuple(r) for r in repeats.remove_repeats(docs, **how).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, left_by_hand(rows, how.get("window", 35))))


def test_repeats_over_many_units(spark, monkeypatch):
    """Few rows a unit, a sketch far too narrow, and one passage that every third text holds."""
    monkeypatch.setattr(repeats, "UNIT_ROWS_LOG2", 2)
    monkeypatch.setattr(repeats, "ROOM", 0.05)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(60))) + (" " + PASSAGE if i % 3 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in repeats.remove_repeats(df, window=5, stripe_windows=1000).collect()]
    assert sorted(got) == sorted(left_by_hand(texts, 5))


def test_sketch_never_falls_short():
    rng = np.random.default_rng(1)
    sketch = repeats.Sketch(64)
    parts = [np.sort(rng.integers(0, 2**32, 40, dtype=np.uint64)) for _ in range(600)]
    parts += [np.array([7, 7], np.uint64), parts[0]]
    for p in parts:
        sketch.merge(p)
    assert (sketch.estimate(parts[0]) == 2).all() and sketch.estimate(np.array([7], np.uint64))[0] == 2
    x = np.sort(rng.integers(0, 2**32, 1000, dtype=np.uint64))
    assert (repeats.unpacked(repeats.packed(x)) == x).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "only this one")], "doc_id long, text string")
    assert fim.fill_in_middle(none).count() == repeats.remove_repeats(none).count() == resample.resample(none, some).count() == 0
    assert [tuple(r) for r in resample.resample(some, none).select("doc_id", "n_features", "rank").collect()] == [(1, 5, None)]
    assert repeats.remove_repeats(some).first().kept == "only this one"
