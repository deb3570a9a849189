"""Operators on documents against brute force, with the odd rows that tables hold."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import _text, decontam, lattice, license, neardup, packing, pii, quality, sharding, toxicity
from helixframe.llm._labels import remainder
from helixframe.llm._text import ALNUM as ALNUM_BYTES, SPACED as SPACED_BYTES, text_words

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (9001, None),
    (9002, ""),
    (9003, " \t\n"),
    (9004, "one"),
    (9005, "one two three four"),
    (9006, "ONE two THREE four"),
    (9007, "word " * 30_000),
    (9008, "x" * 60_000),
    (9009, "repeated row"),
    (9009, "repeated row"),
    (9010, "É è 😀 日本語 ß"),
    (None, "no id here at all"),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The smallest documents and odd rows, with extra columns whose names clash with results."""
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd)
    return d.select("doc_id", F.lit(1).alias("score"), "text", F.lit("x").alias("n_words"), F.lit("y").alias("found"), F.lit(2).alias("th"), F.length("text").alias("n_chars")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def bench(spark, sf):
    odd = [(None, "no id"), (900, None), (901, ""), (902, "one two three four"), (903, "one two three"), (903, "zebra"), (904, "É è")]
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    return b.select(F.col("item_id").cast("long").alias("item_id"), "text").union(spark.createDataFrame(odd, "item_id long, text string"))


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_decontamination(docs, rows, bench):
    windows = defaultdict(set)
    for r in bench.collect():
        if r.item_id is None:
            continue
        w = ALNUM.findall(lower(r.text))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(r.item_id))
    want = []
    for i, text in rows:
        w, hit, items = ALNUM.findall(lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    items |= windows[k]
        want.append((str(i), len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    for block in (10**6, 300):  # one index, and several
        got = decontam.decontaminate(docs, bench, block_words=block).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
        kept = decontam.drop_contaminated(docs, bench, block_words=block)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_items_in_parts_have_the_windows_of_the_whole(spark):
    long = " ".join(f"w{i}" for i in range(95))
    whole = decontam._Index([("a", long)], 10, 5).windows
    parts = list(decontam._parts("a", long, 10, 20))
    assert len(parts) == 5 and sorted({x for _, t, _ in parts for x in decontam._Index([("a", t)], 10, 5).windows}) == sorted(whole)
    items = spark.createDataFrame([("a", long), ("b", "one two")], "item_id string, text string")
    d = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(70, 90))), (2, "w1 w2 w3"), (3, "One, two!")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.decontaminate(d, items, block_words=20).collect()}
    assert got == {1: (20, 1), 2: (0, 0), 3: (2, 1)}


def test_decontamination_of_nothing(docs, bench):
    assert decontam.decontaminate(docs, bench.where("item_id < 0")).where("contaminated").count() == 0
    assert decontam.decontaminate(docs.where("false"), bench).count() == 0


def components(sets, percent=75):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingles(text, k=5):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_near_duplicates(docs, rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    want = components(sets)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {i for i in sets if want[i] == i} | {None})


def test_near_duplicates_that_no_star_joins(spark):
    """A chain and a cloud around a missing centre: many members of a bucket fail against its hub."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    made = []
    for d in range(120):
        w = list(base)
        for p in rng.choice(150, 3, replace=False):
            w[p] = f"e{d}_{p}"
        made.append((d, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == components({i: shingles(t) for i, t in made})


def test_near_duplicates_of_nothing(docs):
    assert neardup.near_duplicates(docs.where("false")).count() == 0
    assert neardup.near_duplicates(docs.where("doc_id = 9001")).first().component_id == 9001


def test_estimates_follow_similarity():
    seeds = neardup._seeds(128)
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8):
        a, b, n = [], [], 400
        for _ in range(30):
            both = round(2 * n * j / (1 + j))
            x = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            a.append(neardup.registers(x[:n], seeds))
            b.append(neardup.registers(x[n - both :], seeds))
        got = neardup.estimate(np.array(a), np.array(b), np.full(30, 400.0), np.full(30, 400.0))
        assert abs(got.mean() - j) < 0.03
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    merged = np.maximum(neardup.registers(x[:300], seeds), neardup.registers(x[200:], seeds))
    assert (merged == neardup.registers(x, seeds)).all()


def test_packing(docs, rows):
    _, exact = packing._encoders()
    got = packing.pack_documents(docs).collect()
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        x = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32
    copies = Counter(i for i, _ in rows)
    for i, x in ids.items():
        assert sum(r.length for r in by_doc[i]) == len(x) * copies[i]
        assert len(by_doc[i]) == -(-len(x) // 2048) * copies[i]
        assert all(r.length == 2048 for r in by_doc[i] if r.piece)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    least = -(-sum(len(ids[i]) for i, _ in rows) // 2048)
    assert len(by_seq) <= least * 1.05 + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 5, 10_000), (100, 100, 2_500)])
def test_packing_plan_holds_every_capacity(rule, caps):
    rng = np.random.default_rng(2)
    counts = dict(Counter(rng.integers(1, 51, 3_000).tolist()))
    steps = packing.plan(counts, *caps, rule)
    bins, seen = defaultdict(list), Counter()
    for length, rank, n, k, first, offset in steps.tolist():
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            bins[first + i // k].append((offset + i % k * length, length))
    assert seen == counts and set(bins) == set(range(len(bins)))
    for b in bins.values():
        b.sort()
        assert all(o == sum(x for _, x in b[:i]) for i, (o, _) in enumerate(b))
        assert sum(x for _, x in b) <= caps[0] and len(b) <= caps[1] and sum(x * x for _, x in b) <= caps[2]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 1_500)])
def test_packing_plan_is_best_fit(rule, caps):
    """Bins against best fit piece by piece: the longest first, each into the best open bin under every capacity."""
    rng = np.random.default_rng(7)
    counts = dict(Counter(rng.integers(1, 38, 300).tolist()))
    weight, full = np.array([1.0, 1e-3, 1e-3]), np.array(caps, float)
    bins = []
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length])
        for _ in range(counts[length]):
            fits = [b for b in bins if (b["left"] >= need).all()]
            if rule == "norm":
                rank = lambda b: round(float((weight * ((b["left"] - need) / full) ** 2).sum()), 12)  # noqa: E731, B023
            else:
                rank = lambda b: round(-float((weight * need / full * b["left"] / full).sum()), 12)  # noqa: E731, B023
            best = min(fits, key=rank, default=None)
            if best is None:
                best = {"left": full.copy(), "has": []}
                bins.append(best)
            best["left"] = best["left"] - need
            best["has"].append(length)
    want = Counter(tuple(b["has"]) for b in bins)
    made = defaultdict(list)
    for length, _, n, k, first, offset in packing.plan(counts, *caps, rule).tolist():
        for i in range(n):
            made[first + i // k].append((offset + i % k * length, length))
    got = Counter(tuple(x for _, x in sorted(b)) for b in made.values())
    assert sum(got.values()) == sum(want.values())
    assert got == want


def test_token_ids_are_those_of_tokenizers():
    _, exact = packing._encoders()
    for t in ["<|endoftext|> a", "  lead", "naïve façade", "日本語 текст", "a" * 5000, " " * 3000, "it's\r\n\tx  y", "½ Ⅷ ² ๓"]:
        assert packing.token_ids(t) == exact.encode(t, add_special_tokens=False).ids


def test_packing_of_nothing(docs):
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_quality(spark, docs, labels, rows):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.score(d, lab).join(lab, "doc_id").where(remainder(5) == 0).toPandas()
    low, high = r.score[r.quality == 0], r.score[r.quality == 1]
    assert (high.to_numpy()[:, None] > low.to_numpy()[None]).mean() > 0.95
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert quality.score(docs, labels.where("false")).first().score == 0.5
    assert quality.score(docs.where("false"), labels).count() == 0


def test_machine_matches_pairwise_sums():
    m = quality.Machine(6, 3)
    rng = np.random.default_rng(1)
    m.w = rng.normal(size=6).astype(np.float32)
    m.v = rng.normal(size=(6, 3)).astype(np.float32)
    ids, x = np.array([0, 2, 5, 1]), np.array([1.0, 0.5, 2.0, 3.0], np.float32)
    raw = m.raw(np.array([0, 3, 4]), ids, x)[0]
    want = sum(m.w[i] * v for i, v in zip(ids[:3], x[:3])) + sum(m.v[ids[a]] @ m.v[ids[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert abs(raw[0] - want) < 1e-4 and abs(raw[1] - m.w[1] * 3) < 1e-5


def edits(a, b):
    """Edit distance in characters, with swaps of neighbours."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_edit_distance():
    import pickle

    terms = ["idiot", "moron", "scum", "idiots", "réeux", "cabrón", "estúpido", "日本語文字"]
    a = pickle.loads(pickle.dumps(toxicity.Automaton(terms)))
    rng = np.random.default_rng(4)
    tried = ["idiot", "idoit", "idio", "iddiot", "scum", "scun", "csum", "moronx", "idiotsx", "xidiot", "the", "réeu", "cabron", "estupido", "日本文語字", "日本文字", "i", "é"]
    for _ in range(1500):
        t = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(0, 3)):
            p = rng.integers(len(t) + 1)
            t[p : p + rng.integers(0, 2)] = rng.choice(list("abcdiorménú語"), rng.integers(0, 2)).tolist()
            if len(t) > 2 and rng.random() < 0.3:
                p = rng.integers(len(t) - 1)
                t[p], t[p + 1] = t[p + 1], t[p]
        tried.append("".join(t) or "x")
    w = text_words([" ".join(tried)], SPACED_BYTES)
    at, term, e, _ = a.run(w)
    got = dict(zip(at.tolist(), e.tolist()))
    for i, t in enumerate(tried):
        d = min((edits(t, x) for x in terms if len(x) >= 5 or t == x), default=9)
        assert got.get(i) == (d if d <= 1 else None), t
    assert all(edits(tried[i], terms[x]) == got[i] for i, x in zip(at.tolist(), term.tolist()))


def test_lexicon_has_no_cap():
    class Row:
        def __init__(self, w):
            self.w, self.p0, self.p1, self.n0, self.n1 = w, 3, 3, 0, 0

    assert len(toxicity._learned([Row(f"t{i}") for i in range(5000)], 100, 1000, None, 3, 2.0)) == 5000 + len(set(toxicity.INSULTS))


def test_quotation_is_told_from_abuse():
    from helixframe.llm._text import ALNUM as KIND
    from helixframe.llm._text import text_words

    lex = toxicity.Lexicon({"idiot": 3.0})
    f = lex.features(text_words(["you are an idiot", 'he wrote the word "idiot" today', "nothing here", "you idiiot", None, ""], KIND))
    marks = lex.features(text_words(["a “idiot” b", "a 'idiot' b", "a 'idiot b", "«idiot»", 'ends with "', 'idiot" begins', "idiot"], KIND))[:, :2] > 0
    assert marks.tolist() == [[False, True], [False, True], [True, False], [False, True], [False, False], [True, False], [True, False]]
    abuse, quoted, wrong, spoken = f[:, 0], f[:, 1], f[:, 2], f[:, 3]
    assert abuse[0] > 0 and spoken[0] > 0 and quoted[1] > 0 and abuse[1] == 0 and wrong[3] > 0 and not f[2].any() and not f[4:].any()


def test_toxicity(spark, docs, labels, rows):
    made = [(i, f"the quick text number {i} says you are a {'flarnok' if i % 4 == 0 else 'friend'} indeed") for i in range(400)]
    d = spark.createDataFrame(made + [(1000, "a flarnik here"), (1001, "wholly clean")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, lab).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400)) and got[1001].predicted == 0
    assert got[1000].score > got[1001].score
    assert {r.doc_id for r in toxicity.drop_toxic(d, lab).collect()} >= {1001, 1, 2, 3}
    odd = toxicity.score(docs, labels).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.score(docs, labels.where("false")).count() == len(rows)
    assert toxicity.score(docs.where("false"), labels).count() == 0


def test_lattice_base_and_marginal(docs, rows):
    tokens = [(i, SPACED.findall(lower(t)) + [""]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, t in tokens)
    got = lattice.lattice_scores(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lattice.lattice_scores(docs.where("false")).count() == 0


def test_lattice_score_is_the_marginal(spark):
    """Scores against expectation-maximisation over explicitly listed segmentations."""
    made = [(i, f"the theory of {['words', 'worldwide', 'straße', 'q'][i % 4]} the {'ab' * (i % 3)}") for i in range(12)] + [(20, "unseen zebras"), (21, None)]
    pieces, logp, _ = lattice.vocabulary()
    index = defaultdict(list)
    for i, p in enumerate(pieces):
        index[p].append(i)

    def ways(text):
        if not text:
            return [[]]
        return [[i, *rest] for n in range(1, len(text) + 1) for i in index.get(text[:n], ()) for rest in ways(text[n:])]

    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, SPACED.findall(lower(t))) for i, t in made]
    paths = {w: ways("▁".encode() + w.encode()) for _, t in tokens for w in t}
    count = Counter(w for i, t in tokens if not held(i) for w in t)
    for _ in range(2):
        expected = np.zeros(len(logp))
        for w, c in count.items():
            p = np.exp([sum(logp[k] for k in path) for path in paths[w]])
            for path, share in zip(paths[w], p / p.sum()):
                np.add.at(expected, path, c * share)
        expected[-1] = sum(not held(i) for i, _ in tokens)
        prior = np.exp(logp) * min(len(logp), 0.1 * expected.sum())
        logp = np.log((expected + prior) / (expected + prior).sum())
    want = {i: sum(np.log10(sum(np.exp(sum(logp[k] for k in path)) for path in paths[w])) for w in t) + logp[-1] / np.log(10) for i, t in tokens}
    for r in lattice.lattice_scores(spark.createDataFrame(made, "doc_id long, text string")).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 * abs(r.score), r


def mirrored(n=1024):
    """A word over two letters and its mirror image that polynomial hashes modulo 2^64 can't tell apart."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [4, 8, 16, 32, 64, 128, 1024, 4096])
def test_words_that_naive_hashes_confuse(n):
    w = text_words([*mirrored(n), mirrored(n)[0]], SPACED_BYTES)
    assert w.hash[0] != w.hash[1] and w.check[0] != w.check[1] and w.hash[0] == w.hash[2] and w.check[0] == w.check[2]
    assert _text.distinct(w)[1].tolist() in ([0, 1, 0], [1, 0, 1])


def test_groups_are_exact_when_hashes_collide():
    first, inverse, n = _text.group(np.array([7, 7, 7, 9]), np.array([1, 2, 1, 5]), np.array([0, 0, 0, 1]))
    assert inverse[0] == inverse[2] != inverse[1] and sorted(n) == [1, 1, 2] and len(first) == 3
    same = _text._set(np.array([5, 5, 5, 1], np.uint64), np.array([1, 2, 1, 3], np.uint64))
    assert len(same) == 3 and same.shared(_text._set(np.array([1, 9], np.uint64), np.array([3, 3], np.uint64))) == 1


def test_no_link_and_no_count_by_hash_alone(spark):
    one, other = mirrored()
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(100) if i not in train)
    d = spark.createDataFrame([(train[0], one), (held, other)], "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.lattice_scores(d).collect()}
    assert got[held].n_known == 1 and got[train[0]].n_known == 2
    assert abs(got[held].base_score - (np.log10(0.1 / 2.3) + np.log10(1.1 / 2.3))) < 1e-9
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == {train[0]: train[0], held: held}


def test_lattice_sums_all_segmentations():
    pieces, logp, _ = lattice.vocabulary()
    index = defaultdict(list)
    for i, p in enumerate(pieces):
        index[p].append(i)
    words = [b"the", b"worldwide", "straße".encode(), b"q" * 70]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    model = lattice.Lattice(pieces, logp)
    got = model.score(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    for w, g in zip(words, got):
        text = "▁".encode() + w
        a = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            a[j] = sum(a[i] * np.exp(logp[k]) for i in range(j) for k in index.get(text[i:j], ()))
        assert abs(np.log(a[-1]) - g) < 1e-9 * abs(g)


def test_licenses(docs, rows):
    got = license.scan(docs).collect()
    assert len(got) == len(rows)
    for r in license.scan(docs.where("doc_id < 9000")).collect():
        w = ALNUM.findall(lower(dict(rows)[r.doc_id]))
        places = [(j, k) for p, k in license.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({k for _, k in places})))
        assert (r.first_word, r.last_word) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert license.scan(docs.where("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("This work: CC BY-SA 4.0", "cc-by-sa-4.0"),
        ("Mozilla Public License 2.0", "mpl-2.0"),
    ],
)
def test_license_rules(spark, text, label):
    r = license.scan(spark.createDataFrame([(1, "before it " * 40 + text + " and after" * 40)], "doc_id long, text string")).first()
    assert label in r.labels.split(","), r.labels
    assert len(license.rules()) > 200


def test_keep_one_of_repeated_ids_with_different_texts(spark):
    said = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    made = [(1, said["a"]), (5, said["a"]), (5, said["b"]), (6, said["c"]), (6, said["d"]), (7, said["c"]), (6, said["c"]), (5, ""), (8, said["d"] + " more"), (6, said["d"] + " more")]
    kept = sorted((r.doc_id, r.text) for r in neardup.keep_one(spark.createDataFrame(made, "doc_id long, text string")).collect())
    assert [(i, t[:1]) for i, t in kept] == [(1, "a"), (5, ""), (5, "b"), (6, "c"), (6, "d")]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Distributed under Apache-2.0", "apache-2.0"),
        ("artistic 2.0", "artistic-2.0"),
        ("OSL-3.0", "osl-3.0"),
        ("ZPL 2.1", "zpl-2.1"),
        ("PHP 3.01", "php-3.01"),
        ("apache2 0", "apache-2.0"),
        ("Boost Software 1.0", "bsl-1.0"),
        ("neither the name of the a b c d e f g h i j k l m n o nor the names of its contributors may be used to endorse", "bsd-3-clause"),
    ],
)
def test_license_rules_hold_their_keywords(text, label):
    kept = license.scanner().detections(text_words(["before it " * 40 + text + " and after" * 40], ALNUM_BYTES))
    assert label in {license.rules()[r].label for _, _, r in kept.get(0, ())}


def test_license_keywords_are_derived_from_patterns():
    assert set(license.keywords("(?:gnu )?(?:lesser|library) general|(?:gnu )?lgpl")) == {"lesser", "library", "lgpl"}
    assert {"licence", "lgpl"} < set(license.keywords("(?:lesser|library) general public <L>|lgpl"))
    assert license.keywords("odc ?by") in (("odcby", "odc"), ("odc", "odcby"))
    assert license.keywords("neither the names? of (?:[^ ]+ ){1,30}endorse")[0] == "neither"
    with pytest.raises(ValueError):
        license.keywords("[0-9]{4}")
    assert len(license.NOTICES) + len(license.NAMES) > 200 and all(r.keywords and 0 < r.reach < 60 for r in license.rules())


def test_license_prefilter_changes_nothing(rows):
    """Scans of stretches around keywords against scans of whole texts by all rules, also on texts made of rule words."""
    s = license.scanner()
    rng = np.random.default_rng(5)
    said = sorted({x for r in s.rules for x in re.findall("[a-z0-9é]+", re.sub(r"\[.*?\]|\{.*?\}", " ", r.pattern))} | set("license licence 2 0 1 3 the of by v version".split()))
    made = [" ".join(rng.choice(said, 400)) for _ in range(25)]
    made += ["driving license for python 2 and php 3 users", "use apache 2.0 here", "neither the name of " + "a b " * 14 + "nor the names of its contributors may be used to endorse"]
    texts = [t for _, t in rows if len(t or "") < 20_000][::4] + made
    w = text_words(texts, ALNUM_BYTES)
    got = s.detections(w)
    for i in range(len(texts)):
        words = [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])]
        assert got.get(i, []) == license.uncontained(set(s.matches(words, range(len(s.rules)))), s.rank), texts[i][:100]
    label = lambda t: {s.rules[r].label for _, _, r in s.detections(text_words([t], ALNUM_BYTES)).get(0, ())}
    assert not label("driving license for python 2 and php 3 users") and "apache-2.0" in label("use apache 2.0 here") and "bsd-3-clause" in label(made[-1])


def test_license_suppression_is_containment():
    rng = np.random.default_rng(6)
    s = license.scanner()
    found = {(int(a), int(a + n), int(r)) for a, n, r in zip(rng.integers(0, 60, 300), rng.integers(1, 12, 300), rng.integers(0, len(s.rules), 300))}
    kept = []
    for x in sorted(found, key=s.rank):
        if not any(a <= x[0] and x[1] <= b for a, b, _ in kept):
            kept.append(x)
    assert license.uncontained(found, s.rank) == sorted(kept)


def test_license_scan_of_very_many_detections():
    import time

    began = time.time()
    assert len(license.scanner().detections(text_words(["cc by " * 100_000], ALNUM_BYTES))[0]) == 100_000
    assert time.time() - began < 30


def test_license_labels_and_scores(spark, docs, rows):
    """labels and score against the kept detections of whole texts."""
    s, text = license.scanner(), dict(rows)
    for r in license.scan(docs.where("doc_id < 60")).collect():
        words = ALNUM.findall(lower(text[r.doc_id]))
        kept = license.uncontained(set(s.matches(words, range(len(s.rules)))), s.rank) if words else []
        base = {k for k in r.base_labels.split(",") if k}
        assert r.labels == ",".join(sorted(base | {s.rules[x[2]].label for x in kept}))
        doubt = np.prod([1 - s.rules[x[2]].confidence for x in kept]) * 0.4 ** len(base)
        assert abs(r.score - (1 - doubt if r.labels else 0)) < 1e-9


def test_license_containment(spark):
    r = license.scan(spark.createDataFrame([(1, "licensed under the apache license version 2 0")], "doc_id long, text string")).first()
    assert r.labels == "apache-2.0"


def test_sharding(docs, rows):
    got = sharding.shuffle_into_shards(docs.repartition(3)).toPandas()
    n = got.shard.value_counts()
    assert len(got) == len(rows) and n.max() - n.min() <= 1 and set(got.shard) == set(range(24))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    want = Counter((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    ids = got.doc_id.map(lambda x: "None" if x is None or x != x else str(int(x)))
    assert Counter(zip(ids, got["size"], got.text_crc32)) == want
    assert sharding.shuffle_into_shards(docs.where("false")).count() == 0


def test_communication_matrix_is_uniform():
    total = np.zeros((3, 4))
    for s in range(400):
        m = sharding.communication_matrix([10, 0, 31], 4, s)
        assert m.sum(1).tolist() == [10, 0, 31] and sorted(m.sum(0).tolist()) == [10, 10, 10, 11]
        total += m
    assert np.allclose(total[0] / 400, 2.5, atol=0.2)


@pytest.mark.parametrize("most", [sharding.NUMPY_MOST, 0])
def test_communication_matrix_has_its_law(most):
    """Chi-square of all matrices with given margins, by numpy's sampler and by inversion."""
    from math import factorial, prod

    rows, cols, tries = [3, 2, 1], [2, 2, 2], 6000
    seen = Counter(tuple(map(tuple, sharding.communication_matrix(rows, 3, s, most).tolist())) for s in range(tries))
    share = lambda m: prod(map(factorial, rows)) * prod(map(factorial, cols)) / factorial(6) / prod(factorial(x) for r in m for x in r)
    assert abs(sum(map(share, seen)) - 1) < 1e-9  # every matrix occurs
    chi = sum((n - tries * share(m)) ** 2 / (tries * share(m)) for m, n in seen.items())
    assert chi < len(seen) - 1 + 5 * (2 * (len(seen) - 1)) ** 0.5


def test_hypergeometric_of_any_size():
    rng = np.random.default_rng(1)
    for good, bad, draws in [(5, 7, 4), (30, 10, 35), (1, 1, 1), (100, 3, 50)]:
        a = np.bincount([sharding.hypergeometric(rng, good, bad, draws, 0) for _ in range(4000)], minlength=draws + 1)
        b = np.bincount(rng.hypergeometric(good, bad, draws, 4000), minlength=draws + 1)
        assert (np.abs(a - b) < 5 * np.sqrt(a + b + 1)).all()
    good, bad, draws = 5 * 10**9, 7 * 10**9, 10**8
    x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(100)], float)
    sd = (draws * (5 / 12) * (7 / 12)) ** 0.5
    assert abs(x.mean() - draws * 5 / 12) < 5 * sd / 10 and 0.7 * sd < x.std() < 1.35 * sd
    m = sharding.communication_matrix([10**9, 3 * 10**9, 7], 3, 5)
    assert m.sum(1).tolist() == [10**9, 3 * 10**9, 7] and np.ptp(m.sum(0)) <= 1


def test_sharding_is_drawn_in_groups(docs, rows):
    few = sharding.shuffle_into_shards(docs.repartition(7), shards=3, groups=2).toPandas()
    n = few.shard.value_counts()
    assert len(few) == len(rows) and n.max() - n.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in few.groupby("shard"))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]


def test_pii_patterns(spark, docs, rows):
    extra = ["a@b.c", "1 " * 20_000, "é😀 a.b@c.de, +1 (555) 123-4567 4111-1111 1111 1111 1.2.3.4.5.6.7.8 999.1.1.1 +1+12 345 678 90", "a@b@c.d.e.@f.g", "4111111111111111" * 30, "..@a.b _x@y.z-@q.r 1.2.3.4@h.i", "00255.1.1.1 256.1.1.1 1.1.1.1a", "+1 2 3 4 5 6 7 8 9 (", "<|@|> @a.b x@ @"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(9500 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = dict([*rows, *((9500 + i, t) for i, t in enumerate(extra))])
    got = pii.digest(pii.spans(d)).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        t = texts[r.doc_id] or ""
        if t.startswith("xxx"):
            continue  # the plain email pattern is quadratic here
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if valid(k, m[0])] for k, p in PATTERNS.items()}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in spans.values()], t[:200]
        assert r.base_sha256 == hashlib.sha256(",".join(x for v in spans.values() for x in v).encode()).hexdigest()
        assert r.spans.startswith(",".join(x for v in spans.values() for x in v))
    assert pii.spans(docs.where("false")).count() == 0


def test_pii_terms_and_sanitising(spark):
    made = [(i, f"common words everywhere {'and then ' * (i % 5)} ok") for i in range(200)]
    made += [(300 + i, f"write to zanzibarski at secret@place.org about common words item {i}") for i in range(3)]
    d = spark.createDataFrame(made, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("found", F.lit(1))
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.spans(d).collect()}
    text = dict(made)
    for i in range(300, 303):
        terms = {text[i][a:b] for k, a, b in spans[i] if k == 4}
        assert "zanzibarski" in terms and "common" not in terms
    assert all(not spans[i] for i in range(200))
    clean = pii.sanitise(d)
    assert clean.columns == d.columns
    out = {r.doc_id: r for r in clean.collect()}
    assert "secret" not in out[300].text and "zanzibarski" not in out[300].text and "[EMAIL]" in out[300].text and out[300].n_chars == len(out[300].text)
    assert out[0].text == text[0]


def _terms(spark, made):
    """Per id the lower-case words that are term spans."""
    d = spark.createDataFrame(made, "doc_id long, text string")
    text = dict(made)
    return {r.doc_id: {text[r.doc_id][s.start : s.end].lower() for s in r.found if s.kind == 4} for r in pii.spans(d).collect()}


def test_pii_terms_of_values_in_one_text(spark):
    made = [(i, f"common words everywhere, item {i} at last.") for i in range(200)]
    made += [(300, "write to zanzibarski at secret@place.org about common words."), (301, "zanzibar calls +1 (555) 123-4567 with common words."), (302, "barbarossa calls +1-555-123-4567 with common words.")]
    got = _terms(spark, made)
    assert "zanzibarski" in got[300] and "zanzibar" in got[301] and "barbarossa" in got[302]
    assert not any("common" in x or "words" in x for x in got.values()) and not any(got[i] for i in range(200))
    d = spark.createDataFrame([("+1 (555) 123-4567", 3), ("+1-555-123-4567", 3), ("007.1.0.1", 1), ("7.1.0.1", 1), ("A@b.C", 0), ("a@B.c", 0)], "value string, kind int")
    keys = [r[0] for r in d.select(pii._key(F.struct("kind", "value"))).collect()]
    assert keys == ["phone:15551234567"] * 2 + ["ip:7.1.0.1"] * 2 + ["email:a@b.c"] * 2


def test_pii_terms_of_the_whole_document(spark):
    far = "common words everywhere " * 20
    made = [(i, f"common words everywhere, item {i} at last.") for i in range(200)]
    made += [(300, f"Zanzibarski says {far} secret@place.org {far} zanzibarski, {far} zanzibarski."), (301, f"barbarossa {far} secret@place.org."), (302, "zanzibarski without the value.")]
    d = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == 4] for r in pii.spans(d).collect()}
    text = dict(made)
    assert [text[300][a:b] for a, b in got[300] if text[300][a:b] != "says"] == ["Zanzibarski", "zanzibarski", "zanzibarski"]
    assert [text[301][a:b] for a, b in got[301]] == ["barbarossa"] and not got[302] and not got[0]
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "zanzibarski" not in clean[300].lower() and "barbarossa" not in clean[301] and "[EMAIL]" in clean[301]


def test_pii_terms_do_not_depend_on_copies(spark):
    made = [(i, f"common words everywhere, item {i} at last.") for i in range(1000)]
    made += [(2000, "zanzibarski at secret@place.org about common words."), (2001, "once more zanzibarski at secret@place.org.")]
    assert "zanzibarski" in _terms(spark, made)[2000]
    got = _terms(spark, made + [(3000 + i, made[-2][1]) for i in range(300)])
    assert all("zanzibarski" in got[i] for i in (2000, 2001, 3000, 3299)) and not any("common" in x for x in got.values())


def test_pii_last_word_is_a_term(spark):
    made = [(i, f"common words everywhere, item {i} at last.") for i in range(200)] + [(300, "mail a@b.org Zanzibarski")]
    assert "zanzibarski" in _terms(spark, made)[300]


def test_pii_has_no_python(spark, docs):
    plan = pii.digest(pii.spans(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_term_spans_match_brute_force(spark, docs, rows):
    """Every term span of all documents against co-occurrence counted in plain Python."""
    import math

    texts = sorted({t or "" for _, t in rows if not (t or "").startswith("xxx")})
    normal = {"email": str.lower, "ip": lambda v: ".".join(str(int(p)) for p in v.split(".")), "card": lambda v: re.sub("[^0-9]", "", v), "phone": lambda v: re.sub("[^0-9]", "", v)}
    terms = {t: {w for w in re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower()) if len(w) >= 4} for t in texts}
    found = {t: [(k, m.start(), m.end(), k + normal[k](m[0])) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])] for t in texts}
    n, nt = len({t for _, t in rows}), Counter(w for t in texts for w in terms[t])
    ne = Counter(v for t in texts for v in {f[3] for f in found[t]})
    net = Counter((v, w) for t in texts for v in {f[3] for f in found[t]} for w in terms[t])
    tells = {(v, w) for (v, w), c in net.items() if math.log2(n * c / (ne[v] * nt[w])) / max(math.log2(n / ne[v]), 1e-9) >= 0.8}
    want = {}
    for t in texts:
        told = {w for v in {f[3] for f in found[t]} for w in terms[t] if (v, w) in tells}
        places = [(m.start(), m.end()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", t) if m[0].lower() in told]
        want[t] = [p for p in places if not any(a < p[1] and p[0] < b for _, a, b, _ in found[t])]
    got = [r for r in pii.spans(docs).collect()]
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t or "")
    assert sum(map(len, want.values())) > 100
    for r in got:
        t = text[r.doc_id][0]
        if not t.startswith("xxx"):
            assert [(s.start, s.end) for s in r.found if s.kind == 4] == want[t], t[:200]


def test_pii_sanitising_matches_brute_force(spark, monkeypatch):
    """Labels, overlaps and chunk borders against one pass over each text; spans of every length against every border."""
    monkeypatch.setattr(pii, "CHUNK", 7)
    names = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]"]
    rng = np.random.default_rng(8)
    made, marks, want = [], [], {}
    for i in range(60):
        t = "".join(rng.choice(list("abé😀 \n"), rng.integers(0, 60)))
        spans = sorted({(int(a), int(min(a + n, len(t))), int(k)) for a, n, k in zip(rng.integers(0, max(len(t), 1), 5), rng.integers(1, 25, 5), rng.integers(0, 5, 5)) if a < len(t)})
        out, pos, end = "", 0, 0
        for a, b, k in spans:
            if a >= end:
                out, pos = out + t[pos:a] + names[k], b
            end = max(end, b)
            pos = max(pos, end)
        want[i] = out + t[pos:]
        made.append((i, -i, t))
        marks += [(i, -i, k, a, b) for a, b, k in spans]
    texts = spark.createDataFrame(made, "th long, tl long, text string")
    got = {r.th: r.clean for r in pii._cleaned(texts, spark.createDataFrame(marks, "th long, tl long, kind int, start int, end int")).collect()}
    assert got == {i: w for i, w in want.items() if i in {m[0] for m in marks}}


def test_pii_of_very_many_values(spark):
    import time

    t = " ".join(f"user{i}@host{i}.org" for i in range(20_000))
    d = spark.createDataFrame([(1, t), (2, "nothing here")], "doc_id long, text string")
    began = time.time()
    assert {r.doc_id: r.n_email for r in pii.digest(pii.spans(d)).collect()} == {1: 20_000, 2: 0}
    assert {r.doc_id: len(r.text) for r in pii.sanitise(d).collect()} == {1: 20_000 * 8 - 1, 2: 12}
    assert time.time() - began < 60


def test_quality_scores_match_plain_pairs(spark, docs, labels, rows):
    """Scores of whole documents against every pairwise product, written out."""
    model = quality.fit(docs, labels)
    text = {i: t for i, t in rows}
    for r in quality.score(docs, labels).where("doc_id < 12 or doc_id between 9001 and 9004").collect():
        w = (text[r.doc_id] or "").encode()
        first, ids, x = quality.features(np.frombuffer(w, np.uint8), np.array([0, len(w)]), 18)
        v, x = model.v[ids].astype(float), x.astype(float)
        products = (v @ v.T) * np.outer(x, x)
        raw = model.w0 + (model.w[ids] * x).sum() + sum(products[i, j] for i in range(len(x)) for j in range(i))
        assert abs(r.score - 1 / (1 + np.exp(-raw))) < 1e-4 and r.predicted == (r.score >= 0.3), r


def test_toxicity_scores_match_plain_matching(spark, docs, labels, rows):
    """Scores against matches found word by word with plain edit distances."""
    lexicon, weights = toxicity.fit(docs, labels)
    terms, text = lexicon.automaton.terms, {i: t for i, t in rows}
    weight = dict(zip(terms, lexicon.weight))
    marks = set(toxicity.QUOTES)
    for r in toxicity.score(docs, labels).where("doc_id < 25 or doc_id between 9001 and 9006").collect():
        t = lower(text[r.doc_id])
        if len(t) > 4000:
            continue
        found = [(m.start(), m.end(), m[0]) for m in ALNUM.finditer(t)]
        words = [x[2] for x in found]
        f, seen = np.zeros(7), set()
        for p, (a, b, w) in enumerate(found):
            lead = len(w) > 1 and w[0] in marks
            core = w[lead:]
            tail = len(core) > 1 and core[-1] in marks
            core = core[: len(core) - tail]
            near = [(0, x) for x in terms if x == core] or [(1, x) for x in terms if len(x) >= 5 and abs(len(x) - len(core)) < 2 and edits(core, x) == 1]
            if not near:
                continue
            e, term = min(near)
            window = words[max(0, p - 6) : p + 7]
            quoted = ((lead or (a > 0 and t[a - 1] in marks)) and (tail or (b < len(t) and t[b] in marks))) or any(x in toxicity.REPORTING for x in window)
            f[1 if quoted else 2 if e else 0] += weight[term]
            f[3] += weight[term] * any(x in toxicity.ADDRESSING for x in window)
            f[5] = max(f[5], weight[term] * (0.5 if quoted or e else 1))
            seen.add(term)
        f[4], f[6] = len(seen), (f[0] + f[2]) / max(len(words), 1) ** 0.5
        f[:5] = np.log1p(f[:5])
        assert abs(r.score - 1 / (1 + np.exp(-(f @ weights[:-1] + weights[-1])))) < 1e-9, (r, t[:100])
