"""Pieces that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import HOT_SHARE, checkpoint, folder, sized, spread, stored

__all__ = ["KEY", "SPACE", "checkpoint", "components", "documents", "folder", "held_out", "keyed", "labelled_sample", "let", "sized", "slices", "spread", "stored", "without", "words"]

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows whose texts a Python worker holds as strings at a time.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in order, ``rows`` at a time; what comes of a slice can leave before the next one's texts are made strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Two 64-bit hashes of a row's id and text: rows that agree in them are the same document.
KEY = ("__key_a", "__key_b")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEY``; null ids and null texts have keys of their own, other columns don't matter."""
    parts = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("doc_id").isNull(), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return docs.withColumns({name: F.xxhash64(F.lit(k), *parts) for k, name in enumerate(KEY)})


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` (with ``KEY``) but for the rows whose key is among the distinct ``keys``."""
    return docs.join(sized(keys.select(*KEY)), list(KEY), "left_anti").select(*docs.columns)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves no remainder by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, also where ``then`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, per_class: bool = False) -> DataFrame:
    """At most ``most`` labelled learning rows ``(text, label)``; the bound is the operator's parameter.

    Rows are taken by a hash of their id, so the choice doesn't depend on
    partitioning. Held-out ids never take part. With ``per_class`` each of the
    labels 0 and 1 gets half of the bound. Ids are chosen first, so only the
    chosen rows' texts move.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.join(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    parts = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(most // 2) for y in (0, 1)] if per_class else [known.orderBy(order, "doc_id").limit(most)]
    ids = [(r.doc_id, r.label) for p in parts for r in p.collect()]
    spark = docs.sparkSession
    if not ids:
        return spark.createDataFrame([], "doc_id long, text string, label int")
    chosen = spark.createDataFrame(ids, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


#: A node with fewer edges than this is no hub; their rows are a few bytes each.
HUB_ROWS = 10_000


def _by_least(rows: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """``rows ⋈ least(key, m, n)``; keys with more than a ``HOT_SHARE`` of ``total`` rows, fewer than that many, are broadcast."""
    limit = max(HUB_ROWS, total // HOT_SHARE)
    if total <= limit:
        return rows.join(least.drop("n"), key)
    hot, cold = F.broadcast(least.where(F.col("n") > limit).drop("n")), least.where(F.col("n") <= limit).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components ``(node, component)`` with the smallest reachable node as name.

    ``nodes(node)`` distinct, ``edges(a, b)`` in any direction. Large-star and
    small-star in turn, as minima by aggregation and joins; a node with very
    many edges is joined by broadcast, so its edges never meet in one task.
    Every round is checkpointed; nothing but a count and a sum comes to the
    driver.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpoint(both)
    n = now.count()
    if not n:
        return nodes.select("node", F.col("node").alias("component"))
    seen = None
    for _ in range(rounds):
        # Large star: every larger neighbour of u points to u's smallest neighbour.
        around = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _by_least(now.select(F.col("b").alias("u"), F.col("a").alias("v")), least, "u", 2 * n).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        pairs = _by_least(large, least, "a", n).select("a", "b", "m")
        small = pairs.select(F.col("b").alias("x"), F.col("m").alias("y")).union(pairs.select(F.col("a").alias("x"), F.col("m").alias("y"))).where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        now = checkpoint(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        n = state.n
        if seen == (state.n, state.h):
            break
        seen = (state.n, state.h)
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
