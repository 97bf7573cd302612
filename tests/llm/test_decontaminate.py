from functools import lru_cache

from buildatlas.llm import decontaminate


@lru_cache(None)
def shingles(text, n):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def contained(text, item):
    n = min(5, len((item or "").split()))
    s = shingles(item, n) if n else set()
    return len(shingles(text, n) & s) / len(s) if s else 0.0


def brute(docs, items, threshold=0.8):
    best = {}
    for i, text in docs:
        for k, item in items:
            c = contained(text, item)
            if c >= threshold:
                best[i, k] = max(c, best.get((i, k), 0.0))
    return {(i, k, round(c, 9)) for (i, k), c in best.items()}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    d, b = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]
    words = b[0][1].split()
    d += [(10**6, "x " * 30000 + b[0][1]), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, " ".join(words[: len(words) * 9 // 10])), (10**6 + 4, "one two")]
    # Short items inside long documents and alone; ids that repeat with other texts; null ids.
    d += [(10**6 + 5, "w " * 500 + "the CAPITAL of\nFrance " + "v " * 500), (10**6 + 6, "capital of france"), (10**6 + 7, "capital france of"), (10**6 + 8, "zyzzyva"), (10**6 + 9, "a zyzzyva b")]
    d += [(10**6 + 10, "clean text"), (10**6 + 10, b[1][1]), (10**6 + 11, " ".join(b[2][1].split()[:20])), (10**6 + 11, " ".join(b[2][1].split()[16:])), (None, b[3][1]), (None, "another clean text")]
    b += [(900, None), (901, ""), (902, "one two"), (903, "Capital of France"), (904, "zyzzyva"), (905, "it is not in any"), (906, "four words not there"), (902, "one two three")]
    docs = spark.createDataFrame([(*x, 1) for x in d], "doc_id long, text string, h int")
    items = spark.createDataFrame([(*x, "clash") for x in b], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, round(r.containment, 9)) for r in decontaminate.pairs(docs, items).collect()}
    assert got == brute(d, b) and {(10**6, b[0][0], 1.0), (10**6 + 5, 903, 1.0), (10**6 + 9, 904, 1.0), (None, b[3][0], 1.0)} <= got
    assert not any(i == 10**6 + 7 for i, _, _ in got)
    kept = sorted((repr(r.doc_id), r.text) for r in decontaminate.clean(docs, items).collect())
    assert kept == sorted((repr(i), t) for i, t in d if not any(contained(t, item) >= 0.8 for _, item in b))
    assert decontaminate.clean(docs, items).columns == docs.columns


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.pairs(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.pairs(some, items).count() == 0 and decontaminate.clean(some, items).count() == 1
    assert decontaminate.pairs(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
