"""SimHash near-duplicates by anchor-point covering.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's 4-word
shingles. Fingerprints link at ``THRESHOLD`` = 4 or fewer differing bits. The
64 bits are cut into five blocks; four differences leave a block without any,
followed by a block with at most one in a circle of five (of the blocks
without differences, not all can stand before one with two or more). So a
table per block needs it equal and looks for at most one difference in the
next block. There a covering code is used: anchors are the codewords of a
shortened Hamming code, every block value has a home anchor, and each
fingerprint is replicated to the anchors that can be home to a value within
the threshold; all lie within covering radius plus threshold. Two links' ends
meet at the home of one of them, where fingerprints are compared.

Equal fingerprints are one class from the start. Per anchor only a spanning
forest of the links leaves the task, so groups of near copies cost their size
in rows, not its square. Anchors with more than ``crowd`` fingerprints are
dealt once more by five further blocks of the bits not yet used, which loses
no link and splits the crowd over tasks.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; texts of any length are hashed whole, in blocks of shingles; a bit
set in exactly half of the hashes (a tie) is 0; repeated rows give a row each;
repeated ids with different texts are different documents; a null id is carried
along and is never a component's name unless all are null; empty tables give no
rows; extra columns are ignored by ``linked`` and carried along by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, components, keyed, sized, slices, spread, stored, without

SHINGLE, SEED, THRESHOLD = 4, 42, 4
WIDTHS, SHIFTS = (13, 13, 13, 13, 12), (0, 13, 26, 39, 52)
#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    h64, sums = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([h64(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + BLOCK)].tolist(), ends[at : at + BLOCK].tolist())], dtype="<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n, bitorder="little").view("<u8")[0])


def covering(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Home anchor of each block value, and the anchors (padded with -1) that a value within one bit has as home."""
    syndrome = np.zeros(1 << width, np.int64)
    values = np.arange(1 << width)
    for j in range(width):
        syndrome ^= np.where(values >> j & 1, j + 1, 0)  # column j of the parity check is j + 1
    leader = {0: 0} | {j + 1: 1 << j for j in range(width)}
    for s in range(16):
        if s not in leader:
            leader[s] = 1 << (width - 1) | 1 << ((s ^ width) - 1)
    home = values ^ np.array([leader[s] for s in range(16)])[syndrome]
    ball = np.sort(np.stack([home] + [home[values ^ (1 << j)] for j in range(width)], axis=1), axis=1)
    ball[:, 1:][ball[:, 1:] == ball[:, :-1]] = -1
    return home, ball


def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row ``(key, fp, home)`` for each table and anchor of a fingerprint."""
    cover = {w: covering(w) for w in set(WIDTHS)}
    for batch in batches:
        for from_ in range(0, len(batch), 4096):
            signed = batch["fp"].to_numpy(np.int64)[from_ : from_ + 4096]
            fp = signed.view(np.uint64)
            blocks = [(fp >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in zip(SHIFTS, WIDTHS)]
            for t in range(5):
                u = (t + 1) % 5
                home, ball = cover[WIDTHS[u]]
                anchors = ball[blocks[u]]
                r, c = np.nonzero(anchors >= 0)
                a = anchors[r, c]
                yield pd.DataFrame({"key": (np.int64(t) << 26) | (blocks[t][r] << 13) | a, "fp": signed[r], "home": home[blocks[u][r]] == a})


def finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Five rows for each of a crowded anchor, by parts of the three blocks that its table has left over."""
    for batch in batches:
        fp, key = batch["fp"].to_numpy(np.int64).view(np.uint64), batch["key"].to_numpy(np.int64)
        rest = np.zeros(len(fp), np.uint64)
        for t in range(5):
            own = (key >> 26 & 7) == t
            at = 0
            for b in ((t + 2) % 5, (t + 3) % 5, (t + 4) % 5):
                rest[own] |= ((fp[own] >> np.uint64(SHIFTS[b])) & np.uint64((1 << WIDTHS[b]) - 1)) << np.uint64(at)
                at += WIDTHS[b]
        for k in range(5):
            part = (rest >> np.uint64(8 * k)).astype(np.int64) & 0xFF
            yield pd.DataFrame({"key": key | np.int64(k + 1) << 29 | part << 32, "fp": batch["fp"], "home": batch["home"]})


def forest(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Tree edges, as positions, of the links within one anchor: each fingerprint found is compared with those not yet found."""
    out = []
    left = np.arange(len(fp))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            p = frontier.pop()
            near = np.bitwise_count(fp[left] ^ fp[p]) <= THRESHOLD
            if not home[p]:
                near &= home[left]
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(int(p), int(q)) for q in found]
                frontier += found.tolist()
    return out


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tree edges ``(a, b)`` of every anchor; rows come sorted by key, groups may span batches."""

    def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        start = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([start, [len(key)]]))
        group = np.repeat(np.arange(len(start)), size)
        a, b = [], []
        # Small groups: neighbours at each distance at once, then trees among what linked.
        small, todo = size[group] <= 48, np.arange(len(key))
        lag, found = 1, []
        while len(todo := todo[(todo + lag < len(key))]):
            todo = todo[(group[np.minimum(todo + lag, len(key) - 1)] == group[todo]) & small[todo]]
            if not len(todo):
                break
            near = (np.bitwise_count(fp[todo] ^ fp[todo + lag]) <= THRESHOLD) & (home[todo] | home[todo + lag])
            found.append((todo[near], todo[near] + lag))
            lag += 1
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        for x, y in found:
            for i, j in zip(x.tolist(), y.tolist()):
                if (p := top(i)) != (q := top(j)):
                    root[q] = p
                    a.append(i)
                    b.append(j)
        for g in np.flatnonzero(size > 48):
            s = slice(start[g], start[g] + size[g])
            for i, j in forest(fp[s], home[s]):
                a.append(i + start[g])
                b.append(j + start[g])
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[np.array(a, np.int64)]), pa.array(signed[np.array(b, np.int64)])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows < 200_000:
            continue
        key, fp, home = (np.concatenate(x) for x in zip(*held))
        whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if whole:
            yield links(key[:whole], fp[:whole], home[:whole])
        held, rows = [(key[whole:], fp[whole:], home[whole:])], len(key) - whole
    if rows:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def edges(classes: DataFrame, crowd: int = 20_000) -> DataFrame:
    """Enough links ``(a, b)`` among the distinct fingerprints ``fp`` to reach every component whole."""
    spark = classes.sparkSession
    rows = classes.select("fp").mapInPandas(anchored, "key long, fp long, home boolean")
    # A crowded anchor has more than ``crowd`` rows, so there are rows / crowd at most; they are counted before a broadcast.
    crowded = rows.groupBy("key").count().where(F.col("count") > crowd).select("key")
    hot = sized(crowded)
    if not hot.isEmpty():
        rows = rows.join(hot, "key", "left_anti").union(rows.join(hot, "key", "left_semi").mapInPandas(finer, "key long, fp long, home boolean"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(compared, "a long, b long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, the key columns and ``fp`` per row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *KEY)), pa.array(fp)], names=["doc_id", *KEY, "fp"])

    keys = ", ".join(f"{k} long" for k in KEY)
    return keyed(docs.select("doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(of, f"doc_id long, {keys}, fp long")


def grouped(prints: DataFrame, crowd: int, *least) -> DataFrame:
    """A row per distinct fingerprint: ``fp``, its ``component`` and the aggregates ``least``."""
    classes = stored(prints.groupBy("fp").agg(*least))
    return stored(classes.join(components(classes.select(F.col("fp").alias("node")), edges(classes, crowd)).withColumnRenamed("node", "fp"), "fp"))


def linked(docs: DataFrame, crowd: int = 20_000) -> DataFrame:
    """``doc_id, fp, component_id`` per row."""
    prints = stored(fingerprints(docs).select("doc_id", "fp"))
    named = grouped(prints, crowd, F.min("doc_id").alias("least"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return spread(prints, spread(named, names, ["component"]).select("fp", "component_id"), ["fp"]).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return linked(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep(docs: DataFrame, crowd: int = 20_000) -> DataFrame:
    """One row of each group, the one with the smallest id (null last); which of equal ids, their keys decide.

    Rows are told apart by their keys, so repeated and null ids do no harm; of
    rows with equal id and text one stays.
    """
    prints = stored(fingerprints(docs))
    # Orders ids with null last, then keys; with the number of rows it stands for.
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", *KEY)
    each = prints.groupBy("fp", "doc_id", *KEY).agg(F.count("*").alias("n"))
    named = grouped(each, crowd, F.min(F.struct(rank.alias("rank"), "n")).alias("best"))
    best = stored(named.groupBy("component").agg(F.min("best").alias("best")).select(*[F.col("best.rank")[k].alias(k) for k in KEY], F.col("best.n").alias("n")))
    own = keyed(docs)
    left = without(own, prints.select(*KEY).distinct().join(best, list(KEY), "left_anti"))
    again = best.where("n > 1").select(*KEY)
    if not again.isEmpty():
        again = sized(again)
        left = left.join(again, list(KEY), "left_anti").unionByName(left.join(again, list(KEY), "left_semi").dropDuplicates(list(KEY)))
    return left.select(*docs.columns)
