"""Personal data by patterns, and terms that disclose it by corpus co-occurrence; DataFrame functions only.

**Base spans** are emails, ip addresses, cards and phone numbers, leftmost and non-overlapping per
kind; a match that fails its check is dropped.  Each base span is a mention of a protected entity (its
kind and normalised value).

**Disclosing terms.**  Every word of a document that mentions an entity, wherever it stands outside the
emails, is judged.  With c an entity, t a word, and the numbers over the different texts of the corpus
(copies of a document count once) n(c) that mention c, n(t) that hold t, n(c, t) that do both, and N of
all, c itself holds IC(c) = log2(N / n(c)) bits and t reveals PMI(c; t) = log2(P(c | t) N / n(c)) of
them.  What t leaves hidden, IC - PMI = -log2 P(c | t), does not depend on N, so a word is judged alike in a
small and in a large corpus.  P(c | t) is taken at the lower end of its confidence interval (Wilson's, one
standard error), and t must be seen with c in ``SEEN`` different texts: few sightings prove less than
many.  In all documents that mention c, words that leave at most ``GENERALISE`` bits hidden are
generalised and words that leave at most ``REMOVE`` bits removed, wherever they stand.  ``disclosure`` is
the lower end of P(c | t).  Documents without a protected entity are never touched; an entity in all
documents holds no information.

Entities that the same documents mention have the same numbers and are counted as one class, so a
document with many entities of its own makes no more pairs than one with a single entity.

Defined results: a null text is empty; offsets are code points, ends exclusive; rows that agree in
doc_id and text get the same result, each its own row; an empty table gives an empty result; other
columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precursor.llm.common import attach, bucket_filter, bucket_of, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns in a form that takes linear time: possessive repeats, and no start inside a run
# of characters whose beginning was already tried (\G: the end of the match before).
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to be looked for at all.
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
_WORD = r"\p{L}+"
_NOT_WORD = r"[^\p{L}]+"
#: Bits of an entity that a word may leave hidden to be generalised, and to be removed.
GENERALISE, REMOVE = 1.0, 0.25
#: Different texts in which a word must stand with the entity.
SEEN = 2
_SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, offset: Column | None = None) -> Column:
    """All matches as (start, end, value), from the pieces between them (lengths count code points)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("v"), F.slice(pieces, 1, F.greatest(F.size(found), F.lit(0))).alias("p"))
    none = F.struct((F.lit(0) if offset is None else offset).cast("int").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + F.length(x["1"])).cast("int")
        end = (start + F.length(x["0"])).cast("int")
        one = F.struct(start.alias("start"), end.alias("end"), x["0"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    both = F.transform(both, lambda x: F.struct(x["v"].alias("0"), x["p"].alias("1")))
    return F.aggregate(both, none, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)  # doubled at even places from the right
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


_CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False))),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _entity(kind: Column, value: Column) -> Column:
    plain = F.when(kind.isin("email", "ip"), F.lower(value)).otherwise(_digits(value))
    return F.concat_ws(":", kind, plain)


def base_spans(text: Column) -> Column:
    """(kind, start, end, value) of all base spans, by kind as listed, then start."""
    def of_kind(kind: str) -> Column:
        passed = F.filter(matches(text, _PATTERNS[kind]), lambda s: _CHECKS[kind](s["value"]))
        named = F.transform(passed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                       s["end"].alias("end"), s["value"].alias("value")))
        none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
        return F.when(_HINTS[kind](text), named).otherwise(none)

    return F.concat(*[of_kind(k) for k in KINDS])


def _pieces(text: Column) -> Column:
    """The text between emails; no other base span has letters."""
    return F.when(text.contains("@"), F.split(text, _PATTERNS["email"], -1)).otherwise(F.array(text))


def _terms(text: Column) -> Column:
    """Distinct words of a text, in lower case."""
    words = F.flatten(F.transform(_pieces(text), lambda p: F.split(p, _NOT_WORD, -1)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), F.lower))


def _places(texts: DataFrame) -> DataFrame:
    """(_doc, term, start, end) of every word of (_doc, _text), in time linear in the text."""
    t = F.col("_text")
    emails = F.when(t.contains("@"), F.regexp_extract_all(t, F.lit(_PATTERNS["email"]), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def steps(p: Column) -> Column:  # (code points before the word, word); the last has no word
        words = F.concat(F.regexp_extract_all(p, F.lit(_WORD), F.lit(0)), F.array(F.lit("")))
        return F.zip_with(F.split(p, _WORD, -1), words, lambda gap, w: F.struct(F.length(gap).alias("gap"), w.alias("word")))

    def email(e: Column) -> Column:
        return F.array(F.struct(F.length(e).alias("gap"), F.lit("").alias("word")))

    none = F.array().cast("array<struct<gap:int,word:string>>")  # behind the last piece
    all_ = F.flatten(F.zip_with(F.transform(_pieces(t), steps), F.concat(F.transform(emails, email), F.array(none)),
                                lambda piece, between: F.concat(piece, between)))
    order = Window.partitionBy("_doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = texts.select("_doc", F.posexplode(all_).alias("pos", "s")).select("_doc", "pos", "s.gap", "s.word")
    end = F.sum(F.col("gap") + F.length("word")).over(order)
    return rows.withColumn("_end", end).where("word != ''").select(
        "_doc", F.lower("word").alias("term"), (F.col("_end") - F.length("word")).cast("int").alias("start"),
        F.col("_end").cast("int").alias("end"))


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Base spans of every row, and the text of those that have any."""
    rows = docs.select(F.col(id).alias("_id"), text_or_empty(text).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_text").alias("_row"), F.md5(F.col("_text").cast("binary")).alias("_key"), "_text",
                       base_spans(F.col("_text")).alias("_base"))
    return rows.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text")))


def _term_counts(docs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(term, n_t): different texts that hold each word; ``texts`` has the number of rows of each text."""
    rows = docs.select(text_or_empty(text).alias("_text")).where("_text != ''")
    copied = texts.where("n > 1").select(F.xxhash64("_key").alias("_h"))
    # all rows, less the further copies: only texts in a copy's filter bucket are brought together
    keyed = rows.withColumn("_key", F.md5(F.col("_text").cast("binary"))).withColumn("_bucket", bucket_of(F.xxhash64("_key")))
    again = (keyed.join(bucket_filter(copied, "_h"), "_bucket", "left_semi").groupBy("_key")
             .agg(F.first("_text").alias("_text"), F.count("*").alias("n")).where("n > 1"))
    weighted = rows.select("_text", F.lit(1).cast("long").alias("w")).unionByName(again.select("_text", (1 - F.col("n")).alias("w")))
    return weighted.select("w", F.explode(_terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.sum("w").alias("n_t"))


def _disclosure(n_ct: Column, n_t: Column) -> Column:
    """Lower end of P(c | t): Wilson's interval at one standard error."""
    p = n_ct / n_t
    return (p + 0.5 / n_t - F.sqrt(p * (1 - p) / n_t + 0.25 / (n_t * n_t))) / (1 + 1.0 / n_t)


def _told(bits: float) -> float:
    """The least P(c | t) that leaves ``bits`` hidden (not the bound itself: one half is even odds)."""
    return 2.0 ** -bits * (1 + 1e-9)


def disclosing_terms(docs: DataFrame, base: DataFrame, held: DataFrame, text: str = "text") -> DataFrame:
    """(_doc, term, disclosure) of the words of each text of ``held`` that leave at most ``GENERALISE`` bits hidden."""
    texts = written(base.groupBy("_key").agg(F.count("*").alias("n")), "pii-texts")
    n_all = float(max(texts.count(), 1))
    mentions = written(held.select("_doc", F.explode("_entities").alias("entity")), "pii-mentions")
    # the documents of an entity: their number and a 128-bit hash of the set
    facts = written(mentions.groupBy("entity").agg(
        F.count("*").alias("n_c"), F.bit_xor(F.xxhash64("_doc")).alias("a"),
        F.bit_xor(F.xxhash64("_doc", F.lit(1))).alias("b")), "pii-entities")
    classes = written(attach(mentions, facts, "entity", "inner").select("_doc", "n_c", "a", "b").distinct(), "pii-classes")
    classes = classes.where((F.col("n_c") >= SEEN) & (F.col("n_c") < n_all))
    # n(c, t) <= n(c) and P(c | t) <= n(c, t) / n(t), so a word that may be marked has n(t) <= n(c) / P
    counts = written(_term_counts(docs, texts, text), "pii-words")
    widest = classes.groupBy("_doc").agg(F.max("n_c").alias("widest"))
    words = held.join(widest, "_doc").select("_doc", "widest", F.explode(_terms(F.col("_text"))).alias("term"))
    near = written(attach(words, counts, "term", "inner").where((F.col("n_t") >= SEEN) & (F.col("n_t") * _told(GENERALISE) <= F.col("widest")))
                   .select("_doc", "term", "n_t"), "pii-near")
    best = _disclosure(F.least("n_c", "n_t"), F.col("n_t"))
    pairs = written(near.join(classes, "_doc").where(best >= _told(GENERALISE)), "pii-pairs")
    found = written(pairs.groupBy("a", "b", "n_c", "term", "n_t").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= SEEN)
                    .withColumn("disclosure", _disclosure(F.col("n_ct"), F.col("n_t")))
                    .where(F.col("disclosure") >= _told(GENERALISE)).select("a", "b", "n_c", "term", "disclosure"), "pii-terms")
    return pairs.join(found, ["a", "b", "n_c", "term"]).groupBy("_doc", "term").agg(F.max("disclosure").alias("disclosure"))


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, _row (a hash of the text) and ``spans`` (kind, start, end): base, then terms.

    Term spans have kind ``generalise`` or ``remove`` and are ordered by kind, then start.
    """
    base = written(_rows(docs, id, text), "pii-base")
    entities = F.array_distinct(F.transform("_base", lambda m: _entity(m["kind"], m["value"])))
    held = written(base.where("_text is not null").groupBy("_key").agg(F.first("_text").alias("_text"), F.first(entities).alias("_entities"))
                   .withColumn("_doc", F.monotonically_increasing_id()), "pii-held")
    found = written(disclosing_terms(docs, base, held, text), "pii-found-terms")
    places = _places(held.join(found.select("_doc").distinct(), "_doc").select("_doc", "_text"))
    level = F.when(F.col("disclosure") >= _told(REMOVE), "remove").otherwise("generalise")
    marks = places.join(found, ["_doc", "term"]).groupBy("_doc").agg(
        F.sort_array(F.collect_list(F.struct(level.alias("kind"), "start", "end"))).alias("_terms"))
    terms = written(marks.join(held.select("_doc", "_key"), "_doc").select("_key", "_terms"), "pii-spans")
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return attach(base.select("_id", "_row", "_key", "_base"), terms, "_key").select(
        F.col("_id").alias(id), "_row",
        F.concat(F.transform("_base", plain), F.transform(F.coalesce("_terms", none), plain)).alias("spans"))


def sanitised(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) with base spans replaced by their kind, terms generalised to ``[TERM]`` or removed."""
    found = written(personal_data(docs, id, text).where(F.size("spans") > 0).select(
        F.col(id).alias("_fid"), F.col("_row").alias("_frow"), "spans").dropDuplicates(["_fid", "_frow"]), "pii-found")
    rows = docs.select(F.col(id).alias("_id"), text_or_empty(text).alias("_text")).withColumn("_row", F.xxhash64("_text"))
    t = F.col("_text")
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        name = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[TERM]").otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        more = F.when(s["start"] >= acc["at"], F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), name)).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t)))

    clean = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)
    return rows.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_row") == F.col("_frow")), "left").select(
        F.col("_id").alias(id), F.when(F.col("spans").isNull(), t).otherwise(clean).alias(text))
