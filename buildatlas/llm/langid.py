"""Language identification by prediction by partial matching.

Per language an order-3 byte context tree is counted on a bounded sample and
frozen. A byte's code length is exact: escape probabilities by method C, with
exclusion of the symbols that longer contexts already offered, down to a
uniform order -1. Frozen trees make the longest known context a state, so the
code lengths of eight languages are one table ``state x symbol`` that whole texts are
looked up in; texts are scored in blocks, without prefixes or caps.

Bytes are lower-cased (ASCII) and digits count as white space. The prediction is the
language with the shortest code; the score is its posterior against the
others for eight characters of average code length. ``und`` with score 0 where
the text is null or has no letter.

Defined cases: ties go to the language first by name; texts of any length are
scored whole, in blocks of bytes; repeated rows give a row each and are all
learnt from; so are repeated ids with different texts; a null ``doc_id`` is
predicted, never learnt from and not held out; empty tables give none; with no
learnable row every prediction is ``und``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, sized

ORDER = 3
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
#: Bytes looked up at a time.
BLOCK = 1 << 20
#: Languages in one table.
TOGETHER = 8
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 32
FOLD[[9, 10, 11, 12, 13]] = 32


def fold(text: str) -> np.ndarray:
    return FOLD[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``ORDER`` + 1 bytes, three blanks before a text counted in, as numbers; and how often each stands."""
    got, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text in texts:
        b = np.concatenate([np.full(ORDER, 32, np.uint8), fold(text)]).astype(np.int64)
        for at in range(0, len(b) - ORDER, BLOCK):
            part = b[at : at + BLOCK + ORDER]
            code = sum(part[d : len(part) - ORDER + d] << 8 * (ORDER - d) for d in range(ORDER + 1))
            u, c = np.unique(code, return_counts=True)
            got.append(u)
            n.append(c)
    u, back = np.unique(np.concatenate(got), return_inverse=True)
    return u, np.bincount(back, np.concatenate(n), len(u)).astype(np.int64)


class Trees:
    """Frozen context trees of all languages; a table for each ``TOGETHER`` of them, so tables grow as the languages do."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        self.blocks = [Block([counts[x] for x in self.langs[i : i + TOGETHER]]) for i in range(0, len(self.langs), TOGETHER)]

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of every text in every language; one row each."""
        return np.hstack([b.bits(texts) for b in self.blocks]) if self.blocks else np.zeros((len(texts), 0))


class Block:
    """Frozen context trees of some languages as one table."""

    def __init__(self, data: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = range(len(data))
        seen = np.zeros(256, bool)
        for grams, _ in data:
            for d in range(ORDER + 1):
                seen[grams >> 8 * d & 255] = True
        seen[32] = True
        self.symbol = np.zeros(256, np.int64)  # 0: never seen
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        a = self.size = int(seen.sum()) + 1
        # Counts by context; a context of k bytes is a number in base a below a**k.
        counts = [[{} for _ in range(ORDER + 1)] for _ in data]
        for li, (grams, often) in enumerate(data):
            s = [self.symbol[grams >> 8 * (ORDER - d) & 255] for d in range(ORDER + 1)]
            for k in range(ORDER + 1):
                code = np.zeros(len(grams), np.int64)
                for d in range(k, -1, -1):
                    code = code * a + s[ORDER - d]
                uniq, back = np.unique(code, return_inverse=True)
                n = np.bincount(back, often, len(uniq))
                ctx, sym = uniq // a, uniq % a
                cut = np.flatnonzero(np.diff(ctx, prepend=-1))
                for i, j in zip(cut, [*cut[1:], len(ctx)]):
                    row = np.zeros(a)
                    row[sym[i:j]] = n[i:j]
                    counts[li][k][int(ctx[i])] = row
        # States: all contexts of full order that any language knows, and shorter ones for the rest.
        contexts: dict[tuple[int, int], int] = {}
        for k in range(ORDER + 1):
            for of in counts:
                for c in of[k]:
                    contexts.setdefault((k, c), len(contexts))
        contexts.setdefault((0, 0), len(contexts))
        self.table = np.zeros((len(contexts), a, len(self.langs)), np.float32)
        for (k, c), row in contexts.items():
            for li, of in enumerate(counts):
                self.table[row, :, li] = self.lengths(of, k, c)
        # Longest known suffix of every context of ORDER bytes.
        state = np.full(1, contexts[(0, 0)], np.int32)
        for k in range(1, ORDER + 1):
            state = np.tile(state, a)  # the oldest byte is the leading digit
            for (j, c), row in contexts.items():
                if j == k:
                    state[c] = row
        self.state = state

    def lengths(self, of: list[dict[int, np.ndarray]], order: int, context: int) -> np.ndarray:
        """Bits of each symbol after ``context``."""
        a = self.size
        p, done, left = np.zeros(a), np.zeros(a, bool), 1.0
        for k in range(order, -1, -1):
            row = of[k].get(context % a**k)
            if row is None:
                continue
            n = np.where(done, 0, row)
            kinds = np.count_nonzero(n)
            if not kinds:
                continue
            total = n.sum() + kinds
            p += left * n / total
            done |= n > 0
            left *= kinds / total
        rest = 256 - np.count_nonzero(done)  # bytes that no context offered, alike
        p[~done] = left / max(rest, 1)
        return -np.log2(p)

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of every text in every language; one row each."""
        a, out = self.size, np.zeros((len(texts), len(self.langs)))
        flat = self.table.reshape(-1, len(self.langs))
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if not group:
                return
            s = np.concatenate([x for _, x in group])
            code = np.full(len(s) - ORDER, 0, np.int64)
            for d in range(ORDER, 0, -1):
                code = code * a + s[ORDER - d : len(s) - d]
            cost = flat[self.state[code].astype(np.int64) * a + s[ORDER:]]
            at = np.cumsum([0] + [len(x) for _, x in group[:-1]])
            # A part's first bytes have the bytes before them, or the padding, as context.
            keep = np.ones(len(s) - ORDER, bool)
            for x in at[1:]:
                keep[x - ORDER : x] = False
            cost[~keep] = 0
            sums = np.add.reduceat(cost, at, axis=0, dtype=np.float64)
            np.add.at(out, [i for i, _ in group], sums)
            group.clear()
            held = 0

        pad = np.full(ORDER, self.symbol[32])
        for i, text in enumerate(texts):
            s = self.symbol[fold(text)]
            before = pad
            for at in range(0, len(s), BLOCK):
                part = s[at : at + BLOCK]
                group.append((i, np.concatenate([before, part])))
                before = np.concatenate([before, part])[-ORDER:]
                held += len(part)
                if held >= BLOCK:
                    flush()
        flush()
        return out


def learn(docs: DataFrame, per_language: int = 300) -> Trees:
    """Trees from at most ``per_language`` documents of each language, those with the smallest hashes of their ids.

    Texts are counted where they are; what comes to the driver are the sums by
    language and run of four bytes.
    """
    rows = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id", "lang").agg(F.xxhash64(F.col("doc_id"), F.lit(11)).alias("h"))
    many = sized(rows.groupBy("lang").agg(F.count("*").alias("n")))
    # Hashes lie evenly, so few more than the rows wanted are below this border; only those are ranked.
    border = (F.col("h") / F.lit(2.0**63) + 1) / 2 <= 4.0 * per_language / F.col("n") + F.lit(1e-9)
    few = rows.join(many, "lang").where((F.col("n") <= 4 * per_language) | border)
    chosen = few.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("at") <= per_language).select("doc_id", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, of in texts.items():
                grams, n = grams_of(of)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    found = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").join(sized(chosen), ["doc_id", "lang"], "left_semi")
    got = found.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Trees({lang: (of["gram"].to_numpy(np.int64), of["n"].to_numpy(np.int64)) for lang, of in got.groupby("lang")})


def predict(docs: DataFrame, per_language: int = 300) -> DataFrame:
    trees = docs.sparkSession.sparkContext.broadcast(learn(docs, per_language))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, score = np.full(len(texts), len(model.langs)), np.zeros(len(texts))
            letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            if model.langs and letters.any():
                bits = model.bits(texts)
                per = bits / np.maximum(1, np.array([[len(t)] for t in texts]))
                better = 2.0 ** (8 * (per.min(axis=1, keepdims=True) - per))
                best = np.where(letters, bits.argmin(axis=1), best)
                score = np.where(letters, 1 / better.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(score, RESULT)
