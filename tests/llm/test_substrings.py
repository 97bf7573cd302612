import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from buildatlas.llm import substrings


def brute(rows):
    split = [(t or "").encode().split() for _, t in rows]
    n = Counter(b" ".join(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = {i + k for i in range(len(w) - 34) if n[b" ".join(w[i : i + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [2_000, 3])
def test_against_brute_force(spark, sf_dir, crowd):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = make(60), make(36)
    rows += [(1000 + i, f"{make(rng.randint(0, 50))} {passage} {make(rng.randint(0, 50))}") for i in range(30)]
    rows += [(2000 + i, f"{make(40)}\n{line} {make(3)}  {' '.join(passage.split()[:34])}") for i in range(9)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "The " * 6000), (3004, make(35)), (3005, rows[0][1]), (3005, rows[0][1]), (3006, f"{passage} {passage}"), (3007, "é\xa0x " * 40)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, seed int")
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.dedup(docs, crowd, 50).collect())
    assert got == brute(rows)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs, crowd, 50).collect()) == got


def test_index_finds_what_is_there():
    rng = np.random.default_rng(2)
    t = np.append(rng.integers(1, 5, 299), 0)  # a last number that occurs once ends it
    index = substrings.Index(t, 5)
    for n in (1, 2, 3, 7, 35):
        for at in rng.integers(0, 299 - n, 40):
            lo, hi = np.array([0]), np.array([len(t)])
            for c in t[at : at + n][::-1]:
                lo, hi = index.back(np.array([c]), lo), index.back(np.array([c]), hi)
            assert hi[0] - lo[0] == sum((t[i : i + n] == t[at : at + n]).all() for i in range(300 - n + 1))


def test_empty(spark):
    assert substrings.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
