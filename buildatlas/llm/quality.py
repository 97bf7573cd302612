"""Quality by nearest-neighbour voting among latent-semantic vectors.

A document is a bag of terms: hashed words, their shapes and the punctuation
about them, and repetitions, with log frequencies and inverse document frequencies of the
sample. A truncated singular value decomposition of a bounded, hash-chosen
sample of labelled rows gives the latent space; the sample's vectors are
broadcast (``most`` x ``rank`` floats). Every document's vector is compared
with all of them by exact blocked cosine products, and its ``neighbours``
nearest vote, weighted by similarity. The vote for label 1 is set to the
labels' real shares, for the sample has half of either label as far as there
are.

Defined cases: null and empty texts, and texts without a known term, get the
share of label 1; without learnable rows of both labels every row gets that
share (1 without any, so nothing is rejected on no evidence); texts of any
length are scored whole; equal similarities (ties) go by the sample's order;
repeated rows give a row each; repeated ids with different texts are scored each
by its text and all learnt from; a null ``doc_id`` is scored, never learnt from
and not held out; empty tables give none; extra columns are ignored by
``classify`` and carried along by ``keep``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, slices

DIMS = 1 << 12
THRESHOLD = 0.3
RESULT = "doc_id long, held_out boolean, score double, predicted int"
PUNCT = re.compile(r"[^\w\s]+")
#: Words whose terms a worker remembers; beyond, they are worked out anew.
REMEMBERED = 50_000


HALF = DIMS // 2


def hashed(x: str) -> int:
    return HALF + zlib.crc32(x.encode("utf-8", "replace")) % HALF


LENGTHS = [hashed(f"n{i}") for i in range(21)]
SHAPES = {x: hashed(f"s{x}") for x in "UTlm-"}
#: Terms for the shares of words that follow themselves.
REPEATED = {x: hashed(f"repeated{x}") for x in (0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64)}


def parts(word: str) -> tuple[int, ...]:
    """Hashed terms of one word: itself, its shape, its length and its punctuation."""
    bare = word if word.isalpha() else PUNCT.sub("", word)
    shape = "-" if not bare else "l" if bare.islower() else "U" if len(bare) > 1 and bare.isupper() else "T" if bare.istitle() else "m"
    out = (zlib.crc32(word.lower().encode("utf-8", "replace")) % HALF, SHAPES[shape], LENGTHS[min(len(bare), 20)])
    return out if bare is word else (*out, *(hashed("p" + p) for p in PUNCT.findall(word)))


def bag(text: str, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text with their log frequencies per 200 words; a word that follows itself is a term too."""
    if len(known) > REMEMBERED:
        known.clear()
    words = text.split()
    ids: list[int] = []
    n: list[int] = []
    get = known.get
    for word, k in Counter(words).items():
        p = get(word)
        if p is None:
            p = known[word] = parts(word)
        ids += p
        n += [k] * len(p)
    again = sum(map(eq, words, words[1:]))
    for share, term in REPEATED.items():
        if again >= share * max(1, len(words)) and again > 2:
            ids.append(term)
            n.append(4 * len(words))
    total = np.bincount(np.array(ids, np.int64), np.array(n, float), DIMS) if ids else np.zeros(DIMS)
    at = np.flatnonzero(total)
    return at, np.log1p(total[at] * (200 / max(1, len(words))))


class Voters:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], shares: tuple[int, int], rank: int = 48, neighbours: int = 25, seed: int = 3) -> None:
        self.prior = shares[1] / sum(shares) if sum(shares) else 1.0
        y = np.array([r[2] for r in rows])
        self.usable = len(set(y.tolist())) == 2
        self.neighbours = neighbours
        if not self.usable:
            return
        x = np.zeros((len(rows), DIMS), np.float32)
        for i, (at, value, _) in enumerate(rows):
            x[i, at] = value
        df = (x > 0).sum(axis=0)
        self.idf = np.where(df > 1, np.log((1 + len(rows)) / (1 + df)) + 0.2, 0).astype(np.float32)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        rng = np.random.default_rng(seed)
        q = np.linalg.qr(x @ rng.normal(size=(DIMS, min(rank + 10, len(rows)))).astype(np.float32))[0]
        for _ in range(4):  # subspace iteration
            q = np.linalg.qr(x @ (x.T @ q))[0]
        _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
        self.basis = np.ascontiguousarray(vt[:rank].T, dtype=np.float32)
        z = x @ self.basis
        self.z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        # A neighbour counts by how much its label is over-represented in the sample.
        n1 = y.mean()
        self.y = y.astype(np.float32)
        self.weight = np.where(y == 1, self.prior / n1, (1 - self.prior) / (1 - n1)).astype(np.float32)

    def score(self, texts: list[str], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not self.usable:
            return out
        known: dict[str, tuple[int, ...]] = self.__dict__.setdefault("_known", {})
        k = min(self.neighbours, len(self.z))
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            z = np.zeros((len(part), self.basis.shape[1]), np.float32)
            for i, t in enumerate(part):
                ids, value = bag(t, known)
                z[i] = (value * self.idf[ids]) @ self.basis[ids]
            norm = np.linalg.norm(z, axis=1)
            cos = (z / np.maximum(norm, 1e-9)[:, None]) @ self.z.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cos, near, axis=1).min(axis=1)
            for i in np.flatnonzero((cos >= least[:, None]).sum(axis=1) > k):  # ties for the last places
                near[i] = np.argsort(-cos[i], kind="stable")[:k]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** 4 * self.weight[near]
            total = w.sum(axis=1)
            vote = (w * self.y[near]).sum(axis=1)
            good = (norm > 1e-9) & (total > 0)
            out[at : at + block][good] = vote[good] / total[good]
        return np.clip(out, 0, 1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        bags = [bag(t, known) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "at": [a.tolist() for a, _ in bags], "value": [v.tolist() for _, v in bags]})


def learn(docs: DataFrame, labels: DataFrame, most: int = 4000) -> Voters:
    """Voters from at most ``most`` labelled rows that aren't held out."""
    sample = labelled_sample(docs, labels, "quality", most, per_class=True)
    rows = sorted((r.doc_id, r.label, r.at, r.value) for r in sample.mapInPandas(features, "doc_id long, label int, at array<int>, value array<float>").collect())
    counts = {r.y: r.n for r in labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n")).collect()}
    return Voters([(np.array(a, np.int64), np.array(v, np.float32), y) for _, y, a, v in rows], (counts.get(0, 0), counts.get(1, 0)))


def classify(docs: DataFrame, labels: DataFrame, most: int = 4000) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, most))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = model.value
        for batch in slices(batches):
            p = voters.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(score, RESULT)


def keep(docs: DataFrame, labels: DataFrame, most: int = 4000) -> DataFrame:
    """``docs`` without those that the voters reject; the columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, most))
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = model.value
        for batch in slices(batches):
            yield batch.filter(pa.array(voters.score([t or "" for t in batch.column(at).to_pylist()]) >= THRESHOLD))

    return docs.mapInArrow(good, docs.schema)
