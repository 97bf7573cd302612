"""Embedding near-dedup by product quantisation.

Unit vectors are assigned to the nearest of K coarse centroids; what is left
is coded in ``PARTS`` subspaces of 256 centroids each. Both codebooks are
fitted on a bounded, hash-chosen sample; every row is indexed. A query probes
every list that can be home to a vector within the threshold: a vector's
distance to the border between its own and another cell bounds how far a
neighbour over there must be. In a list, dot products come from table lookups
(query against codes); with the code's own error added they bound the true
cosine from above, and what reaches the threshold is ranked again by the exact
cosine in double precision. Neither bound can lose a link, so recall is 1.

Lists of neighbouring centroids share a task, so a query is sent once to a
task and not once to each list it probes there. Equal vectors of one label are
one class with its number of copies. A task's vectors and visitors are dealt
in blocks of bounded size. Links are counted where they are found; only a
spanning forest of each block leaves it.

Defined cases: null labels, null or zero vectors and such with null or
non-finite components link with nothing; vectors of different lengths don't
link, and each length has codebooks of its own; a cosine of exactly the
threshold (a tie) links; repeated rows link with each other; a repeated or null
``vec_id`` is a row like any other, but null names no component; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, sized, spread, stored

PARTS, CODES = 8, 256
#: Rounding of a bound; links themselves are judged without it.
SLACK = 1e-6
HOMES, VISITORS = 8_000, 16_000
#: Rounding of the tables in single precision.
COARSE_SLACK = 1e-4


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; empty cells stay where they are."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Codebooks:
    def __init__(self, sample: np.ndarray, lists: int, threshold: float, tasks: int = 1, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        self.coarse = means(sample, lists, 12, rng)
        over = means(self.coarse, tasks, 12, rng)
        self.task = (self.coarse @ over.T - 0.5 * (over * over).sum(axis=1)).argmax(axis=1)
        self.half = (self.coarse**2).sum(axis=1) / 2
        gap = (self.coarse[:, None, :] - self.coarse[None, :, :]) if len(self.coarse) <= 256 else None
        self.apart = np.sqrt((gap**2).sum(axis=2)) if gap is not None else np.sqrt(np.maximum(2 * (self.half[:, None] + self.half[None, :] - self.coarse @ self.coarse.T), 0))
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
        rest = sample - self.coarse[self.home(sample)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.fine = [means(rest[:, cut], CODES, 6, rng) for cut in self.cuts]

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - self.half).argmax(axis=1)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of every sufficient probe: the plane between the cells is within reach."""
        score = x @ self.coarse.T - self.half
        own = score.argmax(axis=1)
        behind = score[np.arange(len(x)), own][:, None] - score
        return np.nonzero(behind <= self.reach * self.apart[own] + SLACK)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error of each row."""
        home = self.home(x)
        rest = x - self.coarse[home]
        codes = np.stack([(rest[:, cut] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1) for cut, c in zip(self.cuts, self.fine)], axis=1).astype(np.uint8)
        return home, codes, np.sqrt(((x - self.decode(home, codes)) ** 2).sum(axis=1))

    def decode(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.coarse[home].copy()
        for k, (cut, c) in enumerate(zip(self.cuts, self.fine)):
            out[:, cut] += c[codes[:, k]]
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Each query's products with the centroids of every subspace."""
        return [(q[:, cut] @ c.T).astype(np.float32) for cut, c in zip(self.cuts, self.fine)]


def near(books: Codebooks, threshold: float, homes: pd.DataFrame, visitors: pd.DataFrame, step: int = 256) -> pd.DataFrame:
    """Links of visitors with homes: each visitor's number of linked vectors and, for both, a common node ``to``."""
    homes = homes.sort_values("list")
    ids, copies, lists = (homes[c].to_numpy(np.int64) for c in ("cid", "copies", "list"))
    h = unit(homes["vec"].tolist())
    codes, error = np.stack([np.frombuffer(c, np.uint8) for c in homes["codes"]]), homes["error"].to_numpy(np.float32)
    found, begin = np.unique(lists, return_index=True)
    end = [*begin[1:], len(lists)]
    guests, own, tree = visitors["cid"].to_numpy(np.int64), visitors["list"].to_numpy(np.int64), np.arange(len(ids))
    out, linked = [], np.zeros(len(ids), bool)
    for s in range(0, len(guests), step):
        q = unit(visitors["vec"].iloc[s : s + step].tolist())
        tables, centre = books.tables(q), q @ books.coarse[found].T
        mine = own[s : s + step]
        behind = ((q * books.coarse[mine]).sum(axis=1) - books.half[mine])[:, None] - (centre - books.half[found])
        probe = behind <= books.reach * books.apart[mine][:, found] + SLACK
        rows, columns = [], []
        for k in range(len(found)):
            v = np.flatnonzero(probe[:, k])
            if not len(v):
                continue
            part = slice(begin[k], end[k])
            bound = centre[v, k].astype(np.float32)[:, None] + (error[part] + np.float32(COARSE_SLACK))[None, :]
            for j, t in enumerate(tables):
                bound += t[v][:, codes[part, j]]  # the query's table, looked up by code
            r, c = np.nonzero(bound >= threshold)
            rows.append(v[r])
            columns.append(c + begin[k])
        if not rows:
            continue
        r, c = np.concatenate(rows), np.concatenate(columns)
        true = np.zeros(len(r), bool)
        for i in range(0, len(r), 50_000):
            j = slice(i, i + 50_000)
            true[j] = (q[r[j]] * h[c[j]]).sum(axis=1) >= threshold
        true &= ids[c] != guests[s + r]
        r, c = r[true], c[true]
        order = np.argsort(r, kind="stable")
        r, c = r[order], c[order]
        for of, v in zip(np.split(c, np.flatnonzero(np.diff(r)) + 1) if len(r) else (), np.unique(r)):
            roots = np.unique(tree[of])
            if len(roots) > 1:
                tree[np.isin(tree, roots)] = roots[0]
            linked[of] = True
            out.append((guests[s + v], int(copies[of].sum()), of[0]))
    rows = [(a, n, ids[tree[of]]) for a, n, of in out] + [(ids[i], 0, ids[tree[i]]) for i in np.flatnonzero(linked)]
    return pd.DataFrame(rows, columns=["cid", "n", "to"], dtype="int64")


def linked(vectors: DataFrame, threshold: float = 0.93, sample: int = 20_000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    spark = vectors.sparkSession
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", doubles.alias("e"))
    usable = F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    # Two hashes of label and components stand for a vector wherever it need not be looked into.
    rows = rows.select("*", *[F.when(F.coalesce(usable, F.lit(False)), F.xxhash64(F.lit(k), "label", "e")).alias(c) for k, c in enumerate("ab")])
    narrow = stored(rows.select("vec_id", "a", "b"))
    classes = stored(rows.where("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("e").alias("e")).withColumn("cid", F.monotonically_increasing_id()))
    parts = [within(classes.where(F.size("e") == r.d), r.n, threshold, sample) for r in classes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    found = spark.createDataFrame([], "cid long, n long, to long")
    for p in parts:
        found = found.union(p)
    found = checkpoint(found)
    n = found.groupBy("cid").agg(F.sum("n").alias("n"))
    slim = classes.select("cid", "a", "b", "copies", "least")
    comp = components(slim.select(F.col("cid").alias("node")), found.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    named = stored(slim.join(comp.withColumnRenamed("node", "cid"), "cid").join(n, "cid", "left"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = spread(named, least, ["component"]).select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    component = F.coalesce("component_id", "vec_id")
    return spread(narrow, named, ["a", "b"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def within(classes: DataFrame, count: int, threshold: float, sample: int) -> DataFrame:
    """Partial counts and tree edges ``(cid, n, to)`` among classes of one length."""
    spark = classes.sparkSession
    chosen = classes.orderBy(F.xxhash64("e", "cid")).limit(sample).select("e").collect() if count > sample else classes.select("e").collect()
    fit = unit([np.array(r.e, "<f8").tobytes() for r in chosen])
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    books = spark.sparkContext.broadcast(Codebooks(fit, int(min(4096, max(16, count**0.5 / 2))), threshold, -(-largest // HOMES)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                e = part.column("e").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(part.num_rows, -1)
                raw = [row.tobytes() for row in e]
                x = unit(raw)
                home, codes, error = b.encode(x)
                r, at = b.probes(x)
                r, task = np.unique(np.stack([r, b.task[at]]), axis=1)
                for of, where, visit in ((np.arange(len(x)), b.task[home], False), (r, task, True)):
                    take = pa.array(of)
                    kept = [part.column(c).take(take) for c in ("label", "cid", "copies")]
                    own = [pa.array(where, pa.int32()), pa.array(home[of], pa.int32()), pa.array([raw[i] for i in of], pa.binary()), pa.array([None if visit else codes[i].tobytes() for i in of], pa.binary()), pa.array(error[of]), pa.array([visit] * len(of))]
                    yield pa.RecordBatch.from_arrays([*kept, *own], names=["label", "cid", "copies", "task", "list", "vec", "codes", "error", "visit"])

    label = classes.schema["label"].dataType.simpleString()
    rows = stored(classes.select("label", "e", "copies", "cid").mapInArrow(assign, f"label {label}, cid long, copies long, task int, list int, vec binary, codes binary, error double, visit boolean"))
    sizes = rows.groupBy("label", "task").agg(F.ceil(F.count(F.when(~F.col("visit"), 1)) / HOMES).cast("int").alias("hs"), F.ceil(F.count(F.when(F.col("visit"), 1)) / VISITORS).cast("int").alias("vs")).where("hs > 0 AND vs > 0")
    rows = rows.join(sized(sizes), ["label", "task"])
    salt = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rest = ("cid", "copies", "list", "vec", "codes", "error", "visit")
    homes = rows.where("NOT visit").select("label", "task", salt("hs").alias("h"), F.explode(span("vs")).alias("v"), *rest)
    visitors = rows.where("visit").select("label", "task", F.explode(span("hs")).alias("h"), salt("vs").alias("v"), *rest)

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        at_home = ~rows["visit"].to_numpy(bool)
        if at_home.all() or not at_home.any():
            return pd.DataFrame(columns=["cid", "n", "to"], dtype="int64")
        return near(books.value, threshold, rows[at_home], rows[~at_home])

    return homes.union(visitors).groupBy("label", "task", "h", "v").applyInPandas(block, "cid long, n long, to long")


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, label, v FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
