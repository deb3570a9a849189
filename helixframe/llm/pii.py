"""Personal data: pattern spans, and terms that give a protected value away.

Everything here is DataFrame expressions. The pattern kinds are found leftmost and non-overlapping by one anchored
expression each (``\\G``, possessive skips), so a text is read once in linear time and without recursion, however long.
Failing matches are dropped without a retry.

Information-theoretic sanitisation then looks at the words of the documents that hold a protected value e, however far
from it. Over the N distinct texts n(e), n(t) and n(e, t) are those that hold the value, the term, and both: copies of a
text change nothing.
``log2(N n(e,t) / (n(e) n(t)))`` bits are what t says about e; as a share of the information content ``log2(N / n(e))`` it
is t's disclosure. A term whose disclosure reaches ``threshold`` is a span of kind ``term`` at each of its places in
the documents that hold e, outside the values; documents without e, which have nothing that it could tell, keep it.
Sanitising replaces it by a general label, as it does with the values themselves. Most values stand in a single text, so no support
beyond that is asked for: there the share is ``1 - log2 n(t) / log2 N``, and common words fall out by their own frequency.
Values are the same if they differ only in case (email), leading zeros (ip) or separators (card, phone).

Arrays hold the pieces of a text only as they are read; places are running sums of piece lengths over rows, and overlaps
are running maxima, so the work is linear in a text with however many values. Sanitising cuts texts into chunks, replaces
in each what spans cover of it, and joins the chunks again. Texts are told apart by 128 bits, and all is done once for
equal texts; where one text has very many rows, adaptive execution splits the join that gives them its spans.

Null and empty texts have no spans. Spans of one start are in the order of kinds; of overlapping spans sanitising keeps the
label of the one that starts first (ties: the shorter, then the kind listed first). Repeated rows give repeated results.
Other columns are ignored by ``spans`` and kept by ``sanitise`` (``n_chars``, where it exists as a number, follows the
text). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixframe.llm._common import materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_EMAIL_TAIL = rf"@{_DOMAIN}++(?:\.{_DOMAIN}++)++"
_IP = r"[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Per kind: what is skipped before a match, and the match.
_PATTERNS = {
    "email": (rf"(?:[^A-Za-z0-9._%+-]++|{_LOCAL}++(?!@{_DOMAIN}++\.{_DOMAIN}))*+", rf"{_LOCAL}++{_EMAIL_TAIL}"),
    "ip": (r"(?:[^0-9]++|[0-9]++(?!\.[0-9]++\.[0-9]++\.[0-9]))*+", _IP),
    "card": (r"(?:[^0-9]++|[0-9](?![\x20-]?[0-9]))*+", _CARD),
    "phone": (rf"(?:[^+]++|\+(?![0-9][\x20().0-9-]+[0-9]))*+", _PHONE),
}
#: A cheap test that a text may hold the kind.
_GATES = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_TERM_GAP = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
_TERM = r"\G([^0-9A-Za-z\x{80}-\x{10FFFF}]*+)([0-9A-Za-z\x{80}-\x{10FFFF}]++)"


KEY = ["th", "tl"]  # what a text is known by
SPAN = "struct<kind:int,start:int,end:int>"
#: Characters of a chunk of a text that is being sanitised.
CHUNK = 2000
#: Most keys of texts (16 bytes each) that are sent to all tasks.
SENT = 1_000_000


def _of(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("th"), F.xxhash64(F.lit(7), text).alias("tl")]


def _valid(s: Column) -> Column:
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    octets = F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(_OCTET))
    card = F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    kind = s["kind"]
    return F.when(kind == 0, True).when(kind == 1, octets).when(kind == 2, card).otherwise(F.length(digits).between(9, 15))


def _key(s: Column) -> Column:
    """What a span's value is counted as."""
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    octets = F.regexp_replace(s["value"], r"(^|\.)0+(?=[0-9])", "$1")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.concat_ws(":", kind, F.when(kind == "email", F.lower(s["value"])).when(kind == "ip", octets).otherwise(digits))


def _pieces(text: Column, pattern: str) -> Column:
    """(size, value) of the pieces that the pattern cuts from the start of the text on: length of all, second group."""
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), i) for i in (0, 2))
    return F.arrays_zip(F.transform(whole, F.length).alias("size"), value.alias("value"))


def _placed(pieces: DataFrame, *within: str) -> DataFrame:
    """Rows (KEY, within, nth, size, value) with start and end: each value ends where the pieces up to its own do."""
    w = Window.partitionBy(*KEY, *within).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ended = pieces.withColumn("end", F.sum("size").over(w).cast("int"))
    return ended.select(*KEY, *within, "value", (F.col("end") - F.length("value")).alias("start"), "end")


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, KEY, and pieces (kind number, size, value) and text of those texts that hold a valid value."""
    df = docs.select("doc_id", *_of(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<struct<kind:int,size:int,value:string>>")
    for i, k in enumerate(KINDS):
        skip, match = _PATTERNS[k]
        own = F.lit(i).alias("kind")
        found = F.transform(_pieces(F.col("text"), rf"\G({skip})({match})"), lambda z: F.struct(own, z["size"].alias("size"), z["value"].alias("value")))  # noqa: B023
        found = F.when(F.col("text").rlike(_GATES[k]), found).otherwise(none)
        df = df.withColumn(k, F.when(F.exists(found, _valid), found).otherwise(none))
    df = df.withColumn("pieces", F.concat(*KINDS))
    some = F.size("pieces") > 0
    return df.select("doc_id", *KEY, F.when(some, F.col("pieces")).alias("pieces"), F.when(some, F.col("text")).alias("text"))


def _terms(texts: DataFrame, *keep: str) -> DataFrame:
    """keep, term: the distinct words of each text, lower-cased."""
    return texts.select(*keep, F.explode(F.array_distinct(F.split(F.lower("text"), _TERM_GAP))).alias("term")).where(F.length("term") >= 4)


def _small(keys: DataFrame) -> DataFrame:
    """keys, sent to all tasks where they are at most ``SENT`` rows, so that texts that are held against them stay in place."""
    return F.broadcast(keys) if keys.limit(SENT + 1).count() <= SENT else keys


def _disclosing(docs: DataFrame, rows: DataFrame, held: DataFrame, values: DataFrame, threshold: float) -> DataFrame:
    """KEY, term: the terms of held texts whose disclosure of one of their values reaches the threshold."""
    copies = rows.groupBy(*KEY).agg(F.count("*").alias("copies"))
    n = copies.count()
    copies = _small(materialise(copies.where("copies > 1")))
    said = values.select(*KEY, _key(F.struct("kind", "value")).alias("value")).distinct()
    # values of the same texts have the same terms: one stands for all
    whole = [F.sum(F.col(k).cast("decimal(38,0)")).alias(f"sum_{k}") for k in KEY]
    sets = said.groupBy("value").agg(F.count("*").alias("ne"), *whole)
    sets = sets.groupBy("ne", "sum_th", "sum_tl").agg(F.min("value").alias("value")).select("value", "ne")
    entities = materialise(said.join(sets, "value"))
    # n(e, t) <= n(e): terms of more documents than that can't reach the threshold
    reach = lambda ne: F.lit(n * (1 + 1e-9)) * F.pow(ne / F.lit(float(max(n, 1))), F.lit(float(threshold)))
    most = entities.agg(F.coalesce(reach(F.max("ne")), F.lit(0.0))).first()[0]
    # counted per term before the join: each task sends a row a term
    often = max(most, n / 1000)
    weighed = docs.select(*_of(F.col("text")), "text").join(copies, KEY, "left").select("text", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))
    words = _terms(weighed, "weight").groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("nt"))
    counts = materialise(words.where((F.col("nt") <= most) | (F.col("nt") > often)))
    # words of a thousandth of the documents: at most a thousand times the words of a document
    rare = _terms(held, *KEY).join(F.broadcast(counts.where(F.col("nt") > often).select("term")), "term", "left_anti")
    pairs = rare.join(counts.where(F.col("nt") <= most), "term").join(entities, KEY).where(F.col("nt") <= reach(F.col("ne")))
    pairs = materialise(pairs.select(*KEY, "value", "term", "ne", "nt"))
    bits = F.log2(F.lit(float(n)) * F.col("net") / (F.col("ne") * F.col("nt")))
    share = bits / F.greatest(F.log2(F.lit(float(max(n, 1))) / F.col("ne")), F.lit(1e-9))
    told = pairs.groupBy("value", "term").agg(F.count("*").alias("net"), F.first("ne").alias("ne"), F.first("nt").alias("nt")).where(share >= threshold)
    return pairs.join(told.select("value", "term"), ["value", "term"]).select(*KEY, "term").distinct()


def _places(held: DataFrame, values: DataFrame, told: DataFrame) -> DataFrame:
    """KEY, start, end of the told terms (KEY, term) in the held texts, outside all values."""
    texts = held.join(told.select(*KEY).distinct(), KEY, "left_semi")
    words = _placed(texts.select(*KEY, F.posexplode(_pieces(F.col("text"), _TERM)).alias("nth", "p")).select(*KEY, "nth", "p.*"))
    hits = words.withColumn("term", F.lower("value")).join(told, [*KEY, "term"])
    # a value that begins before the term's end and ends after its start overlaps it
    none = F.lit(None).cast("int")
    at = hits.select(*KEY, F.col("end").alias("at"), F.lit(0).alias("tie"), "start", "end", none.alias("upto"))
    at = at.union(values.select(*KEY, F.col("start").alias("at"), F.lit(1).alias("tie"), none, none, F.col("end").alias("upto")))
    w = Window.partitionBy(*KEY).orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, 0)
    free = at.withColumn("upto", F.max("upto").over(w)).where("start is not null and coalesce(upto <= start, true)")
    return free.select(*KEY, "start", "end")


def _marked(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs (doc_id, KEY, some); the distinct texts with values (KEY, text); their spans (KEY, kind, start, end)."""
    docs = docs.select("doc_id", "text")
    scanned = materialise(_scan(docs))
    held = materialise(scanned.where("pieces is not null").select(*KEY, "pieces", "text").dropDuplicates(KEY))
    values = _placed(held.select(*KEY, F.posexplode("pieces").alias("nth", "p")).select(*KEY, "nth", "p.*"), "kind")
    values = materialise(values.where(_valid(F.struct("kind", "value"))))
    texts = held.select(*KEY, "text")
    terms = _places(texts, values, _disclosing(docs, scanned, texts, values, threshold))
    marks = values.select(*KEY, "kind", "start", "end").union(terms.select(*KEY, F.lit(len(KINDS)), "start", "end"))
    return scanned.select("doc_id", *KEY, F.col("pieces").isNotNull().alias("some")), texts, materialise(marks)


def spans(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document (doc_id, text): doc_id, KEY, found: sorted (kind number, start, end); kind 4 is a disclosing term."""
    rows, _, marks = _marked(docs, threshold)
    found = marks.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).cast(f"array<{SPAN}>").alias("found"))
    held = rows.where("some").join(found, KEY, "left").select("doc_id", *KEY, "found")
    return rows.where("not some").select("doc_id", *KEY, F.array().cast(f"array<{SPAN}>").alias("found")).union(held)


def digest(found: DataFrame) -> DataFrame:
    """The counts and the joined spans of spans()."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    said = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])))
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def _cleaned(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """KEY, clean: the texts that have marks, with a label for each run of overlapping spans."""
    w = Window.partitionBy(*KEY).orderBy("start", "end", "kind")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = marks.withColumn("new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("kind", "new").alias("kind"))
    # each chunk that a run touches gets its part of it; the label stands where the run starts
    runs = runs.withColumn("c", F.explode(F.expr(f"sequence(int(start div {CHUNK}), int((end - 1) div {CHUNK}))")))
    own = [F.greatest(F.col("start") - F.col("c") * CHUNK, F.lit(0)).alias("lo"), F.least(F.col("end") - F.col("c") * CHUNK, F.lit(CHUNK)).alias("hi")]
    label = F.when(F.expr(f"start div {CHUNK} = c"), F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])[F.col("kind")]).otherwise("")
    cuts = runs.select(*KEY, "c", F.struct(*own, label.alias("label")).alias("cut")).groupBy(*KEY, "c").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    chunks = texts.join(marks.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), 0)).alias("c", "chunk"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    put = lambda acc, s: F.struct(F.concat(acc["out"], F.substring("chunk", acc["pos"] + 1, s["lo"] - acc["pos"]), s["label"]).alias("out"), s["hi"].alias("pos"))
    clean = F.aggregate("cuts", start, put, lambda acc: F.concat(acc["out"], F.substring("chunk", acc["pos"] + 1, F.lit(CHUNK))))
    done = chunks.join(cuts, [*KEY, "c"], "left").select(*KEY, F.struct("c", F.coalesce(clean, "chunk").alias("chunk")).alias("part"))
    return done.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["chunk"]), "").alias("clean"))


def sanitise(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs, all columns, with each span of the text replaced by a label; overlapping spans become one."""
    _, texts, marks = _marked(docs, threshold)
    th, tl = _of(F.col("d.text"))
    m = materialise(_cleaned(texts, marks))
    keys = _small(m.select(*KEY))
    same = lambda x: (th == F.col(f"{x}.th")) & (tl == F.col(f"{x}.tl"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    follow = kinds.get("n_chars") in ("int", "bigint")
    # only texts that have marks move to meet their clean forms
    d = docs.alias("d")
    joined = d.join(keys.alias("k"), same("k"), "left_semi").join(m.alias("m"), same("m"))
    cols = [F.col("m.clean").alias("text") if c == "text" else F.length("m.clean").cast(kinds[c]).alias(c) if c == "n_chars" and follow else F.col(f"d.`{c}`") for c in docs.columns]
    length = F.length("d.text").cast(kinds["n_chars"]) if follow else None
    rest = d.join(keys.alias("k"), same("k"), "left_anti").select(*[length.alias(c) if c == "n_chars" and follow else F.col(f"d.`{c}`") for c in docs.columns])
    return joined.select(*cols).union(rest)
