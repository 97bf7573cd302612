import numpy as np
import pandas as pd
import pytest
import xxhash

from buildatlas.llm import simhash


def brute_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fp = np.array([f for _, f in rows], dtype=np.uint64)
    comp = [i for i, _ in rows]
    while True:
        new = [min(c for c, near in zip(comp, np.bitwise_count(fp ^ f) <= 4) if near) for f in fp]
        if new == comp:
            return dict(zip([i for i, _ in rows], comp))
        comp = new


def test_fingerprints_and_components(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n ", "One", "one TWO  three", "É é　x İ ß", "w " * 30000, texts[0], texts[1] + " more", "a b c d", "A\tB\x0bc d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", simhash.F.lit("clash"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()}
    prints = [(i, brute_print(t)) for i, t in enumerate(texts)]
    comp = brute_components(prints)
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in prints}
    kept = {r.doc_id for r in simhash.keep(docs).collect()}
    assert kept == {i for i in comp if comp[i] == i}


@pytest.mark.parametrize("crowd", [20_000, 8])
def test_edges_reach_every_component(spark, crowd):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = []
    for f in base:  # chains of copies with up to four changed bits, one dense group
        for _ in range(120 if f == base[0] else 4):
            f = f ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 5), replace=False).astype(np.uint64))
            near.append(f)
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    signed = fps.view(np.int64)
    frame = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    found = {(r.node, r.component) for r in simhash.components(frame.select(simhash.F.col("fp").alias("node")), simhash.edges(frame, crowd)).collect()}
    rows = sorted(zip(signed.tolist(), fps.tolist()))
    assert found == set(brute_components(rows).items())


def test_keep_decides_by_row(spark):
    a, b = "one two three four five six", "quite another text stands here now"
    rows = [(3, a), (5, a), (5, b), (None, a), (None, "only under a null id, all by itself"), (7, "seven stands alone in this table"), (7, "seven stands alone in this table"), (2, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, fp string, component long")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep(docs).collect()), key=repr)
    assert kept == sorted([(3, a), (5, b), rows[4], rows[5], (2, None)], key=repr)
    assert simhash.keep(docs).columns == docs.columns and simhash.keep(docs.limit(0)).count() == 0


def test_empty(spark):
    assert simhash.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
