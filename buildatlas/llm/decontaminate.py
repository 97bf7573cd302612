"""Benchmark decontamination by size-partitioned MinHash containment (native).

Texts are lower-cased and cut at white space into shingles of five words. An
item of fewer words is one shingle of its own length, and is looked for among
the documents' runs of that many words, so it is found inside long documents
as well. Items fall in size classes by powers of two of their number of
distinct shingles; the sketch of an item in a class is its smallest hashes, one
more than a document may miss at the threshold for the largest size of the
class. So a document that holds the threshold's share of an item's shingles
holds at least one of its sketch. Documents are not sketched, for the smallest
hashes of a long document need not hold those of a short item in it: all their
shingles' hashes are streamed past the sketches, and the search loses nothing,
however long the document is. Found pairs are verified by exact containment of
the shingles' strings.

Defined cases: rows are judged one by one: of repeated ids with different texts
each text counts for itself, and the pairs name the id once with its highest
containment; a null ``doc_id`` or ``item_id`` is an id like any other. Null text
counts as empty; an item without words matches nothing; very long texts are
searched whole; equal containments (ties) are all reported; empty tables give
none; extra columns are ignored by ``pairs`` and kept by ``clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, checkpoint, keyed, let, sized, without, words

N = 5
#: Sketch rows or document keys up to which they are broadcast (some 20 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(w: Column, n: int) -> Column:
    """Distinct shingles of ``n`` words as strings; none in fewer words."""
    some = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def hashes(w: Column, n: int) -> Column:
    """One hash for each shingle of ``n`` words, equal for equal shingles, repeats included."""
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(w, i + k) for k in range(1, n)]))


def joined_over(w: Column, sizes: list[int], of) -> Column:
    return reduce(F.concat, [of(w, n) for n in sizes])


def found(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``KEY``, ``doc_id``, ``item_id`` and ``containment`` of every document and item text at or over ``threshold``."""
    listed = keyed(items.select(F.col("item_id").alias("doc_id"), "text")).dropDuplicates(list(KEY))
    listed = listed.select(F.col("doc_id").alias("item_id"), F.struct(*KEY).alias("item"), words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    listed = checkpoint(listed.withColumn("k", F.least(F.size("w"), F.lit(N))))
    sizes = sorted(r.k for r in listed.select("k").distinct().collect())  # at most N numbers
    if not sizes:
        return keyed(docs.select("doc_id", "text")).select(*KEY, "doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("containment")).limit(0)
    own = lambda of: reduce(lambda acc, n: F.when(F.col("k") == n, of(F.col("w"), n)).otherwise(acc), sizes, F.lit(None))
    item = listed.select("item", F.array_sort(F.array_distinct(own(hashes))).alias("h"))
    top = F.pow(F.lit(2), F.ceil(F.log2(F.size("h"))))
    keep = (F.floor((1 - threshold) * top + F.lit(1e-9)) + 1).cast("int")
    sketch = item.select("item", F.explode(F.slice("h", F.lit(1), keep)).alias("h"))
    if sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    texts = keyed(docs.select("doc_id", "text"))
    each = texts.select(*KEY, F.explode(let(words(F.lower("text")), lambda w: joined_over(w, sizes, hashes))).alias("h"))
    near = checkpoint(each.join(sketch, "h").select(*KEY, "item").distinct())
    # Exact containment: only texts of found documents move.
    of_items = listed.select("item", F.explode(own(shingles)).alias("s"))
    total = of_items.groupBy("item").agg(F.count("*").alias("size"))
    ids = near.select(*KEY).distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    some = texts.join(ids, list(KEY), "left_semi").select(*KEY, "doc_id", F.explode(let(words(F.lower("text")), lambda w: joined_over(w, sizes, shingles))).alias("s"))
    held = some.join(of_items, "s").distinct().groupBy(*KEY, "doc_id", "item").agg(F.count("*").alias("n"))
    both = held.join(near, [*KEY, "item"], "left_semi").join(total, "item").withColumn("containment", F.col("n") / F.col("size")).where(F.col("containment") >= threshold)
    return both.join(listed.select("item", "item_id"), "item").select(*KEY, "doc_id", "item_id", "containment")


def pairs(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, containment)`` of every pair at or over ``threshold``, each pair of ids once."""
    return found(docs, items, threshold).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whatever their ids are."""
    bad = found(docs, items, threshold).select(*KEY).distinct()
    return without(keyed(docs), bad).select(*docs.columns)


ORACLE = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS iid, item_id, least(len(w), 5) AS k, w FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark)),
bs AS (SELECT DISTINCT iid, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM iw WHERE k > 0),
ds AS (SELECT DISTINCT rid, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM dw, (SELECT DISTINCT k FROM iw WHERE k > 0)),
n AS (SELECT iid, count(*) AS size FROM bs GROUP BY iid),
c AS (SELECT rid, iid, count(*) AS n FROM ds JOIN bs USING (k, s) GROUP BY rid, iid)
SELECT doc_id, item_id, max(c.n / n.size) AS containment FROM c JOIN n USING (iid) JOIN dw USING (rid) JOIN iw USING (iid) WHERE c.n / n.size >= 0.8 GROUP BY doc_id, item_id
"""
