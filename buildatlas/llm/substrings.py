"""Substring dedup with an FM-index per shard.

A window is ``WINDOW`` = 35 consecutive words. The smallest hash among a
window's 8-word shingles is its seed, so equal windows have equal seeds; a
snippet is a run of windows of one document with one seed, and every window
lies in exactly one snippet. A seed that stands once in the corpus, and once in
its snippet, proves that none of its windows stands anywhere else; these
snippets go first.

All others are dealt by seed to shards of bounded words. A shard's index holds
each distinct snippet once, with its number of copies as weight: suffixes in
order of their first 35 words give the BWT, kept in a wavelet matrix of packed
bits; a packed bit a suffix tells where the next group of equal windows begins,
and each group has its weight. The shard's snippets are then streamed against
it. Backward search goes on while what it found weighs two or more, so it
yields matching statistics cut at the window's length: a search that ends
earlier rules out all windows that hold the words found so far, and one that
gets there reports the window and goes on to the window before with a single
step, the interval being widened to its group again. The windows found are
reported as intervals of words.

Seeds with more than ``crowd`` distinct snippets, such as those of a passage in
very many contexts, don't go to a shard, which they could outgrow: their windows
are counted by hash, with partial sums before the shuffle. That is exact as
well. Words and windows are compared by 64-bit hashes of their bytes; snippets,
counted windows and documents are told apart by 128 bits.

Defined cases: null text has no words; texts under 35 words lose nothing; texts
of any length are searched whole; windows that overlap their own copy count;
repeated rows repeat each other and lose all that is long enough; repeated and
null ids give a row each, by text; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, sized, spread, stored

WINDOW, SEED = 35, 8
#: Windows of a snippet, at most; repetitive text is cut into more.
LONGEST = 2048
U = np.uint64
ODD = [U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WINDOW)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Hasher:
    """64-bit hashes of a text's words."""

    def __init__(self) -> None:
        import xxhash

        self.of, self.known = xxhash.xxh64_intdigest, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, bytes]:
        """The hashes, and the words joined by one space."""
        words = (text or "").encode("utf-8", "replace").split()
        if len(self.known) > 300_000:
            self.known.clear()
        known, of = self.known, self.of
        out = [known.get(w) for w in words]
        for i, h in enumerate(out) if None in out else ():
            if h is None:
                out[i] = known[words[i]] = of(words[i])
        return np.array(out, dtype=U), b" ".join(words)


def rolled(w: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each ``k`` consecutive words."""
    n = len(w) - k + 1
    out = np.zeros(n, U)
    for j in range(k):
        out += w[j : j + n] * ODD[(j + salt) % WINDOW]
    return mixed(out)


def runs(w: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, number of windows, seed and digest of each snippet, and whether its seed may stand in it twice."""
    none = np.zeros(0, np.int64)
    if len(w) < WINDOW:
        return none, none, none.astype(U), none.astype(U), none.astype(bool)
    low = each = rolled(w, SEED)
    for k in (1, 2, 4, 8):  # minimum over 16 starts, then over 28
        low = np.minimum(low[:-k], low[k:])
    over = WINDOW - SEED + 1 - 16
    low = np.minimum(low[:-over], low[over:])
    # Shingles that are the smallest of some window: equal to the largest minimum of the windows about them.
    span = WINDOW - SEED + 1
    most = np.concatenate([np.zeros(span - 1, U), low, np.zeros(span - 1, U)])
    for k in (1, 2, 4, 8, over):
        most = np.maximum(most[:-k], most[k:])
    chosen = each[most == each]
    new = np.concatenate([[True], low[1:] != low[:-1]])
    start = np.flatnonzero(new)
    n = np.diff(np.concatenate([start, [len(low)]]))
    if (n > LONGEST).any():
        start = np.concatenate([np.arange(s, s + k, LONGEST) for s, k in zip(start, n)])
        n = np.diff(np.concatenate([start, [len(low)]]))
    # Digest of words [start, start + n + 34) from prefix sums that forget where they begin.
    power = np.cumprod(np.full(len(w) + 1, ODD[0], U))
    prefix = np.concatenate([np.zeros(1, U), np.cumsum(mixed(w) * power[: len(w)])])
    inverse = U(pow(int(ODD[0]), -1, 1 << 64))
    back = np.cumprod(np.full(len(w) + 1, inverse, U))
    end = start + n + WINDOW - 1
    digest = mixed((prefix[end] - prefix[start]) * back[start] + n.astype(U))
    return start, n, low[start], digest, np.isin(low[start], chosen[1:][chosen[1:] == chosen[:-1]])


def suffixes(t: np.ndarray) -> np.ndarray:
    """Rank of each suffix of ``t`` by its first ``WINDOW`` numbers: how many suffixes are smaller; equal ones share it.

    Prefix doubling; only suffixes that are not yet alone are sorted again.
    """
    n = len(t)
    rank = np.searchsorted(np.sort(t), t)
    left = np.arange(n)
    depth = 1
    while depth < WINDOW:
        size = np.bincount(rank[left], minlength=n)
        left = left[size[rank[left]] > 1]
        by = min(depth, WINDOW - depth)
        after = np.where(left + by < n, rank[np.minimum(left + by, n - 1)] + 1, 0)
        key = rank[left] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        old, at = rank[left], np.arange(len(left))
        first = np.concatenate([[True], old[1:] != old[:-1]]) if len(left) else np.zeros(0, bool)
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(left) else first
        rank[left] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        depth += by
    return rank


class Bits:
    """Packed bits with the number of ones before any place."""

    def __init__(self, b: np.ndarray) -> None:
        self.words = np.packbits(np.concatenate([b.astype(np.uint8), np.zeros(-len(b) % 64 + 64, np.uint8)]), bitorder="little").view("<u8")
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def before(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        return self.sums[at] + np.bitwise_count(self.words[at] & ((U(1) << (i & 63).astype(U)) - U(1)))


class Index:
    """FM-index of numbers below ``kinds`` that end in 0, suffixes ordered to the window's depth; ``weight`` by place in ``t``."""

    def __init__(self, t: np.ndarray, kinds: int, weight: np.ndarray | None = None) -> None:
        rank = suffixes(t)
        order = np.argsort(rank, kind="stable")
        bwt = t[order - 1]
        self.n = len(t)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=kinds))])
        self.levels = max(1, int(kinds - 1).bit_length())
        self.bits, self.zeros = [], []
        first = np.zeros(kinds, np.int64)
        symbols = np.arange(kinds)
        for level in range(self.levels - 1, -1, -1):
            b = bwt >> level & 1
            self.bits.append(Bits(b))
            self.zeros.append(int(len(b) - b.sum()))
            ones = self.bits[-1].before(first)
            first = np.where(symbols >> level & 1, self.zeros[-1] + ones, first - ones)
            bwt = np.concatenate([bwt[b == 0], bwt[b == 1]])
        self.shift = self.before[:-1] - first
        begins = np.diff(rank[order], prepend=-1) > 0
        self.group, self.begin = Bits(begins), np.append(np.flatnonzero(begins), len(t)).astype(np.int32)
        self.weight = np.concatenate([[0], np.cumsum((np.ones(len(t), np.int64) if weight is None else weight)[order])])

    def back(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where interval ends ``i`` go when ``c`` is put before the match."""
        shift = self.shift[c]
        for k in range(self.levels):
            ones = self.bits[k].before(i)
            i = np.where(c >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i + shift

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = self.back(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return ends[: len(c)], ends[len(c) :]

    def widened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of equal windows that hold the places ``lo``."""
        g = self.group.before(lo + 1) - 1
        return self.begin[g].astype(np.int64), self.begin[g + 1].astype(np.int64)

    def heavy(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[hi] - self.weight[lo] > 1


def matched(index: Index, t: np.ndarray, s: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Marks at the windows of ``t`` that weigh two or more in the index, among those from each ``s`` to before ``stop``."""
    marks = np.zeros(len(t), bool)
    size = len(t)

    # From the left to the first such window; what is found to be alone is skipped with all windows that hold it.
    last = stop - 1
    first = []
    length, lo, hi = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.full(len(s), size)
    while len(s):
        lo, hi = index.step(t[s + WINDOW - 1 - length], lo, hi)
        length += 1
        alone = ~index.heavy(lo, hi)
        full = ~alone & (length == WINDOW)
        first.append(np.stack([s[full], last[full]]))
        s = np.where(alone, s + WINDOW - length + 1, s)
        length[alone], lo[alone], hi[alone] = 0, 0, size
        more = ~full & (s <= last)
        s, last, length, lo, hi = s[more], last[more], length[more], lo[more], hi[more]

    # From the last window back to that one; after a window that is found, each costs one step.
    stop, s = np.concatenate(first, axis=1) if first else np.zeros((2, 0), np.int64)
    length, lo, hi = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.full(len(s), size)
    while len(s):
        on = length == WINDOW  # the interval is that of the window behind
        lo, hi = index.step(np.where(on, t[s], t[s + WINDOW - 1 - np.minimum(length, WINDOW - 1)]), lo, hi)
        if on.any():
            lo[on], hi[on] = index.widened(lo[on])
        length = np.minimum(length + 1, WINDOW)
        alone = ~index.heavy(lo, hi)
        full = ~alone & (length == WINDOW)
        marks[s[full]] = True
        length[alone], lo[alone], hi[alone] = 0, 0, size
        s = s - (alone | full)
        more = s >= stop
        if not more.all():
            s, stop, length, lo, hi = s[more], stop[more], length[more], lo[more], hi[more]
    return marks


def intervals(marks: np.ndarray) -> list[tuple[int, int]]:
    """The words that marked windows cover, as intervals."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > WINDOW)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + WINDOW).tolist()))


def repeated(snippets: list[np.ndarray], weights: np.ndarray, unit: int = 64) -> list[list[tuple[int, int]]]:
    """Intervals of each distinct snippet whose windows stand twice or more, weights counted, in the shard."""
    sizes = np.array([len(s) for s in snippets])
    t = np.zeros(sizes.sum() + len(sizes), np.int64)
    begin = np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))
    inside = np.ones(len(t), bool)
    inside[begin + sizes] = False
    kinds, back = np.unique(np.concatenate(snippets), return_inverse=True)
    t[inside] = back + 1  # 0 parts the snippets
    index = Index(t, len(kinds) + 1, np.repeat(weights, sizes + 1))
    last = begin + sizes - WINDOW + 1
    s = np.concatenate([np.arange(b, e, unit) for b, e in zip(begin, last)])
    stop = np.minimum(s + unit, np.repeat(last, -(-(last - begin) // unit)))
    marks = matched(index, t, s, stop)
    return [intervals(marks[b:e]) for b, e in zip(begin, last)]


ROWS = ", ".join(f"{k} long" for k in KEY) + ", doc_id long, n_words long, sha string, start int, n int, seed long, digest long, again boolean"
SPANS = "seed long, digest long, spans array<struct<a:int,b:int>>"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (``start`` null) and one for each of its snippets."""
    hasher = Hasher()
    schema = pa.schema([(k, pa.int64()) for k in KEY] + [("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("start", pa.int32()), ("n", pa.int32()), ("seed", pa.int64()), ("digest", pa.int64()), ("again", pa.bool_())])
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in KEY)
        parts, words, sha = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            w, joined = hasher(text)
            words.append(len(w))
            sha.append(hashlib.sha256(joined).hexdigest())
            start, n, seed, digest, again = runs(w)
            if len(start):
                parts.append((np.full(len(start), a[i]), np.full(len(start), b[i]), start.astype(np.int32), n.astype(np.int32), seed.view(np.int64), digest.view(np.int64), again))
        none = lambda k, n: pa.nulls(n, schema.field(k).type)
        m = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(sha, pa.string()), *[none(k, m) for k in ("start", "n", "seed", "digest", "again")]], schema=schema)
        if parts:
            ka, kb, *of = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(ka), pa.array(kb), *[none(k, len(ka)) for k in ("doc_id", "n_words", "sha")], *map(pa.array, of)], schema=schema)


def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The word hashes of wanted snippets."""
    hasher = Hasher()
    names = ["seed", "digest", "copies", "hot", "words"]
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["text"], batch["wanted"]):
            w, _ = hasher(text)
            rows += [(x["seed"], x["digest"], x["copies"], x["hot"], w[x["start"] : x["start"] + x["n"] + WINDOW - 1].tobytes()) for x in wanted]
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Intervals of the windows that repeat, shard by shard (one partition each)."""
    rows = pd.concat([*batches, pd.DataFrame(columns=["seed", "digest", "copies", "words"])])
    if len(rows):
        spans = repeated([np.frombuffer(w, U) for w in rows["words"]], rows["copies"].to_numpy(np.int64))
        yield pd.DataFrame([(s, d, [{"a": x, "b": y} for x, y in of]) for s, d, of in zip(rows["seed"], rows["digest"], spans) if of], columns=["seed", "digest", "spans"])


def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of hot seeds' snippets by two hashes."""
    for batch in batches:
        for seed, digest, copies, words in zip(batch["seed"], batch["digest"], batch["copies"], batch["words"]):
            w = np.frombuffer(words, U)
            a, b = rolled(w, WINDOW), rolled(mixed(w), WINDOW, 1)
            yield pd.DataFrame({"seed": seed, "digest": digest, "copies": copies, "i": np.arange(len(a), dtype=np.int32), "a": a.view(np.int64), "b": b.view(np.int64)})


def spanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of repeated windows as intervals."""
    for batch in batches:
        spans = [intervals(np.isin(np.arange(max(x) + 1), x)) for x in batch["bits"]]
        yield pd.DataFrame({"seed": batch["seed"], "digest": batch["digest"], "spans": [[{"a": a, "b": b} for a, b in of] for of in spans]})


def removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, left = [], [], []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
            words = kept = (text or "").encode("utf-8", "replace").split()
            if marks:
                change = np.zeros(len(words) + 1, np.int64)
                for x in marks:
                    for of in x["spans"]:
                        change[x["start"] + of["a"]] += 1
                        change[x["start"] + of["b"]] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            left.append(b" ".join(kept).decode("utf-8", "replace"))
        out = [*(batch.column(c) for c in (*KEY, "doc_id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=[*KEY, "doc_id", "n_words", "n_removed", "kept"])


REMOVED = ", ".join(f"{k} long" for k in KEY) + ", doc_id long, n_words long, n_removed long, kept string"


def with_key(docs: DataFrame) -> DataFrame:
    """Equal rows share a key: what holds for one holds for the other."""
    return keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(*KEY, "doc_id", "text")


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts whose key is among ``ids``, told before any text moves if the keys can be broadcast."""
    return texts.join(sized(ids.select(*KEY).distinct()), list(KEY), "left_semi")


def marked(docs: DataFrame, crowd: int, per_shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with keys; a row per document (``KEY, doc_id, n_words, sha``); and ``KEY, marks`` where something repeats."""
    texts = with_key(docs)
    first = stored(texts.select(*KEY, "doc_id", "text").mapInArrow(cut, ROWS))
    rows = first.where("start IS NOT NULL").select(*KEY, "start", "n", "seed", "digest", "again")
    # Most seeds stand once in the corpus; their snippets go before anything else is done.
    live = stored(rows.groupBy("seed").agg(F.count("*").alias("count"), F.max("again").alias("again")).where("count > 1 OR again").select("seed", "count"))
    rows = stored(spread(rows, live.select("seed"), ["seed"], counts=live))
    classes = stored(rows.groupBy("seed", "digest").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "start", "n")).alias("at")))
    seeds = classes.groupBy("seed").count()
    placed = spread(classes, seeds.select("seed", F.col("count").alias("kinds")), ["seed"], counts=seeds)
    # One row per text: the wanted snippets' words.
    snippet = F.struct("at.start", "at.n", "seed", "digest", F.least("copies", F.lit(2).cast("bigint")).alias("copies"), (F.col("kinds") > crowd).alias("hot"))
    wanted = stored(placed.groupBy(*[F.col("at")[k].alias(k) for k in KEY]).agg(F.collect_list(snippet).alias("wanted")))
    once = only(texts.select(*KEY, "text"), wanted).join(wanted, list(KEY)).dropDuplicates(list(KEY))
    got = stored(once.select("text", "wanted").mapInPandas(fetch, "seed long, digest long, copies long, hot boolean, words binary"))
    total = got.where("NOT hot").agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    spans = got.where("NOT hot").repartition(max(1, -(-int(total) // per_shard)), "seed").mapInPandas(search, SPANS)
    each = stored(got.where("hot").mapInPandas(windows, "seed long, digest long, copies long, i int, a long, b long"))
    often = each.groupBy("a", "b").agg(F.sum("copies").alias("n"), F.count("*").alias("count"))
    bits = spread(each, often.where("n > 1").select("a", "b"), ["a", "b"], counts=often).groupBy("seed", "digest").agg(F.collect_set("i").alias("bits"))
    found = stored(spans.union(bits.mapInPandas(spanned, SPANS)))
    marks = spread(rows, found, ["seed", "digest"]).groupBy(*KEY).agg(F.collect_list(F.struct("start", "spans")).alias("marks"))
    return texts, first.where("start IS NULL").select(*KEY, "doc_id", "n_words", "sha"), stored(marks)


def dedup(docs: DataFrame, crowd: int = 2_000, per_shard: int = 1_000_000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row, ``kept`` being the kept words joined by one space."""
    texts, _, marks = marked(docs, crowd, per_shard)
    return texts.join(marks, list(KEY), "left").select(*KEY, "doc_id", "text", "marks").mapInArrow(removal, REMOVED).drop(*KEY)


def digest(docs: DataFrame, crowd: int = 2_000, per_shard: int = 1_000_000) -> DataFrame:
    """As ``dedup``, with the digest of what is kept; texts in which nothing repeats don't move."""
    texts, all_, marks = marked(docs, crowd, per_shard)
    changed = only(texts, marks).join(marks, list(KEY)).dropDuplicates(list(KEY)).select(*KEY, "doc_id", "text", "marks")
    less = changed.mapInArrow(removal, REMOVED).select(*KEY, "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return all_.join(less, list(KEY), "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
h AS (SELECT rid, s, md5(array_to_string(w[s:s+34], ' ')) AS h FROM win),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM r),
x AS (SELECT rid, list(i) AS gone FROM g GROUP BY rid),
k AS (SELECT d.rid, d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN x USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
