"""Secret scan with corpus-wide ownership frequency (native).

Candidates are matched per document; the hashes of their values are counted
corpus-wide by distinct repositories (``source``) and owners (its part before
the first ``/``). A value that many owners hold is a copied example, one that
few hold looks live. A live value is also found where it stands without its
keyword, as span ``reuse``.

Defined cases: null text counts as empty; texts of any length are scanned whole;
null source is an owner of its own; a value that exactly ``example_owners`` hold
(a tie) is an example; repeated rows, repeated ids and null ids each give a row;
empty tables give none; extra columns of the input are ignored by ``digest`` and
carried along by ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import checkpoint, spread, stored

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Bare strings that could be a value seen elsewhere.
BARE = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}+"
KINDS = ("assign", "access", "hex")


def base(text: Column) -> Column:
    """The contract's spans of one text, with the secret itself as value."""
    return F.concat(
        spans.find(text, "assign", 0, ASSIGN, keep=lambda v: F.length(v) >= 6, value=1),
        spans.find(text, "access", 1, ACCESS),
        spans.find(text, "hex", 2, HEX),
    )


def spotted(docs: DataFrame, *carry: str | Column) -> DataFrame:
    """``rid, source, base, bare`` per row beside the columns to ``carry``; ``bare`` could be values seen elsewhere."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*carry, F.coalesce(F.col("source"), F.lit("")).alias("source"), F.monotonically_increasing_id().alias("rid"), base(text).alias("base"), F.filter(spans.find(text, "reuse", 3, BARE), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("bare"))


def classed(found: DataFrame, example_owners: int) -> DataFrame:
    """The rows of ``found`` (materialised, as by ``spotted``) with ``extra`` reuse spans and ``live`` base spans."""
    hashed = lambda v: F.xxhash64(v)
    cand = found.where(F.size("base") + F.size("bare") > 0).select("rid", "source", F.explode(F.concat("base", "bare")).alias("s")).select("rid", "source", "s", hashed(F.col("s.value")).alias("h"))
    owner = F.substring_index("source", "/", 1).alias("owner")
    held = cand.groupBy("h", "source").agg(F.max(F.col("s.ord") < 3).alias("keyed")).select("h", "source", owner, "keyed")
    freq = held.groupBy("h").agg(F.max("keyed").alias("keyed"), F.count("*").alias("repos"), F.count_distinct("owner").alias("owners"))
    known = freq.where("keyed").select("h", "repos", "owners")
    marked = spread(cand, known, ["h"]).select("rid", F.struct("s.*").alias("s"), (F.col("owners") < example_owners).alias("live"))
    agg = marked.groupBy("rid").agg(F.collect_list(F.when(F.col("live"), F.col("s"))).alias("live"))
    joined = found.join(agg, "rid", "left")
    live = F.coalesce(F.col("live"), F.array().cast(spans.SPAN))
    # A reuse span that only repeats a base span's place says nothing new.
    extra = F.filter(live, lambda s: (s["ord"] == 3) & ~F.exists(F.col("base"), lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    return joined.withColumns({"extra": extra, "live": F.filter(live, lambda s: s["ord"] < 3)})


def scan(docs: DataFrame, example_owners: int = 3) -> DataFrame:
    """One row per document: ``rid, doc_id, spans`` plus per-span classes ``live``.

    ``spans`` holds base spans and added ``reuse`` spans; ``live`` holds those
    whose value fewer than ``example_owners`` owners share.
    """
    return classed(checkpoint(spotted(docs, "doc_id")), example_owners).select("rid", "doc_id", "base", "extra", "live")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, then ``n_live`` and ``n_example``."""
    n = lambda k: spans.count(F.col("base"), k).alias(f"n_{k}")
    return scan(docs).select("doc_id", *[n(k) for k in KINDS], F.sha2(spans.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.joined(F.concat("base", "extra")).alias("spans"), F.size("live").cast("long").alias("n_live"), (F.size("base") - F.size("live")).cast("long").alias("n_example"))


def mask(docs: DataFrame, example_owners: int = 3) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by its kind in brackets; ``n_chars`` follows the text.

    Base spans are all masked, copied examples as ``[EXAMPLE]``; live values
    that stand without their keyword become ``[SECRET:REUSE]``. Rows are told
    apart by row ids, so null and repeated ``doc_id`` do no harm.
    """
    columns = docs.columns
    found = stored(spotted(docs, F.struct(*columns).alias("row")))
    held = F.size("base") + F.size("bare") > 0
    judged = classed(found.where(held).drop("row"), example_owners).select("rid", F.concat("base", "extra").alias("spans"), F.transform("live", lambda s: s["value"]).alias("live"))
    word = lambda s: F.when((s["ord"] == 3) | F.array_contains("live", s["value"]), F.concat(F.lit("[SECRET:"), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("[EXAMPLE]"))
    hits = found.where(held).select("rid", "row").join(judged, "rid").withColumn("text", spans.cut(F.col("row.text"), F.col("spans"), word))
    new = {"text": F.col("text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    out = hits.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])
    return found.where(~held).select("row.*").unionByName(out)
