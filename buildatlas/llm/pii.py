"""Personal data with information-theoretic sanitisation (native).

Four kinds of entities are matched per document. All words of the documents
are then judged by corpus co-occurrence: for a term t and an entity e,
p(e | t) is the share of the documents with t in which e stands too, wherever.
The information that t gives about e is log2(p(e | t) / p(e)) bits; a term that
gives at least ``bits`` of it and at least ``share`` of certainty, seen with e
in ``support`` documents or more, discloses the entity. Each of its occurrences
in any document, outside of entities, becomes an added span: ``term`` (to be
removed) or, where it discloses several entities, ``hint`` (to be generalised).

Defined cases: a term is a word of three characters or more that begins with a
letter, case ignored; words inside entities count as seen. Measures equal to a
threshold (ties) disclose. Null text counts as empty; texts of any length are
read whole; repeated rows and ids and null ids each give a row and count as a
document each; empty tables give none; extra columns are ignored by ``digest``
and carried along by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import checkpoint, sized, spread, stored

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"(?<![\p{L}\p{N}_])[\p{L}][\p{L}\p{N}_]{2,}+"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    d = F.reverse(digits(v))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base(text: Column) -> Column:
    """The contract's spans of one text."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    small = lambda p: (F.length(part(p)) <= 3) & (F.when(F.length(part(p)) <= 3, part(p).cast("int")) <= 255)
    ten = lambda v: F.length(digits(v)).between(10, 15)
    none = F.array().cast(spans.SPAN)
    email = F.when(text.contains("@"), spans.find(text, "email", 0, EMAIL)).otherwise(none)
    phone = F.when(text.contains("+"), spans.find(text, "phone", 3, PHONE, keep=ten)).otherwise(none)
    return F.concat(
        email,
        spans.find(text, "ip", 1, IP, keep=lambda v: F.forall(F.split(v, r"\."), small)),
        spans.find(text, "card", 2, CARD, keep=luhn),
        phone,
    )


def terms(text: Column) -> Column:
    """The distinct terms of one text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def told(found: DataFrame, bits: float, share: float, support: int) -> DataFrame:
    """``t, kind`` of the terms that disclose an entity of ``found(rid, t, base)``.

    What is pruned before pairs are made could not pass: n_et is at most n_e,
    n_t and the number of entity documents with t, and p(e | t) is at most 1.
    """
    n, gain = found.count(), 2.0**bits
    held = checkpoint(found.where(F.size("base") > 0).select("rid", F.explode(F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], s["value"])))).alias("e")))
    n_e = held.groupBy("e").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") * gain <= n))
    held = checkpoint(spread(held, n_e, ["e"]))
    near = found.where(F.size("base") > 0).select("rid", "t").join(held.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode(terms(F.col("t"))).alias("t"))
    around = sized(near.groupBy("t").agg(F.count("*").alias("n_around")).where(F.col("n_around") >= support))
    # Document frequencies of the candidate terms, over all documents.
    n_t = found.select(F.explode(terms(F.col("t"))).alias("t")).join(around.select("t"), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n_t"))
    cand = n_t.join(around, "t").where((F.col("n_around") >= share * F.col("n_t")) & (share * gain * F.col("n_t") <= n)).select("t", "n_t")
    pairs = near.join(sized(cand), "t").join(held, "rid")
    joint = pairs.groupBy("e", "t").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t")).where(F.col("n_et") >= support)
    given = F.col("n_et") / F.col("n_t")
    # A term that tells of several entities names none of them: it is generalised.
    return joint.where((given >= share) & (F.log2(given / (F.col("n_e") / F.lit(n))) >= bits)).groupBy("t").agg(F.when(F.count("*") > 1, "hint").otherwise("term").alias("kind"))


def marked(docs: DataFrame, bits: float, share: float, support: int, *carry: str | Column) -> tuple[DataFrame, DataFrame]:
    """``rid, t, base`` and the columns to ``carry`` of each row; ``rid, extra`` of the rows with disclosing terms."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = stored(docs.select(*carry, F.monotonically_increasing_id().alias("rid"), text.alias("t"), base(text).alias("base")))
    slim = found.select("rid", "t", "base")
    names = sized(told(slim, bits, share, support))
    here = slim.select("rid", F.explode(terms(F.col("t"))).alias("t")).join(names, "t").groupBy("rid").agg(F.collect_list("t").alias("names"), F.collect_list(F.when(F.col("kind") == "hint", F.col("t"))).alias("hints"))
    every = spans.find(F.col("t"), "term", 4, TERM, keep=lambda v: F.array_contains("names", F.lower(v)))
    free = F.filter(every, lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    kind = lambda s: F.array_contains("hints", F.lower(s["value"]))
    extra = F.transform(free, lambda s: F.struct(s["start"].alias("start"), F.when(kind(s), 5).otherwise(4).alias("ord"), s["end"].alias("end"), F.when(kind(s), "hint").otherwise("term").alias("kind"), s["value"].alias("value")))
    return found, slim.join(here, "rid").select("rid", extra.cast(spans.SPAN).alias("extra"))


def scan(docs: DataFrame, bits: float = 6.0, share: float = 0.5, support: int = 3) -> DataFrame:
    """``rid, doc_id, base, extra`` per document; ``extra`` are all occurrences of disclosing terms."""
    found, extra = marked(docs, bits, share, support, "doc_id")
    return found.select("rid", "doc_id", "base").join(extra, "rid", "left").select("rid", "doc_id", "base", F.coalesce("extra", F.array().cast(spans.SPAN)).alias("extra"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, then ``n_terms`` added spans."""
    n = lambda k: spans.count(F.col("base"), k).alias(f"n_{k}")
    return scan(docs).select("doc_id", *[n(k) for k in KINDS], F.sha2(spans.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.joined(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, bits: float = 6.0, share: float = 0.5, support: int = 3) -> DataFrame:
    """``docs`` with entities masked, disclosing terms removed and hints generalised; ``n_chars`` follows the text.

    An entity becomes its kind in brackets, a term nothing, a hint ``[NAME]``
    where it begins with a capital and ``[WORD]`` elsewhere. Rows are told
    apart by row ids.
    """
    columns = docs.columns
    found, extra = marked(docs, bits, share, support, F.struct(*columns).alias("row"))
    both = found.select("rid", "row", "base").join(extra, "rid", "left").withColumn("spans", F.concat("base", F.coalesce("extra", F.array().cast(spans.SPAN))))
    general = lambda s: F.when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    word = lambda s: F.when(s["kind"] == "term", "").when(s["kind"] == "hint", general(s)).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    out = both.withColumn("text", spans.cut(F.col("row.text"), F.col("spans"), word))
    new = {"text": F.col("text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])
