"""Learnt operators against brute force and held-out accuracy."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from buildatlas.llm import langid, quality, toxicity

RULE = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " 12 ## "), (10**6 + 3, "x" * 200_000), (10**6 + 3, "word " * 50_000), (None, "no id")]


def tables(spark, name="sf0.01"):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "text", "lang")
    return docs.union(spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, lang string")), spark.read.parquet(f"/root/testdata/{name}/labels.parquet")


def auc(y, s):
    y, order = np.array(y), np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def classifier(spark, classify, column, threshold):
    docs, labels = tables(spark)
    got = [r for r in classify(docs, labels).collect()]
    assert len(got) == 1000 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    assert all(r.held_out == (r.doc_id is not None and RULE(r.doc_id)) for r in got)
    y = {r.doc_id: r[column] for r in labels.collect()}
    held = [(y[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in y]
    assert auc(*zip(*held)) > 0.9
    # Held-out labels teach nothing.
    flipped = labels.withColumn(column, toxicity.F.when(toxicity.held_out(), 1 - labels[column]).otherwise(labels[column]))
    assert sorted((r.score) for r in classify(docs, flipped).collect()) == sorted(r.score for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify(docs, none).count() == len(got) and classify(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    classifier(spark, toxicity.classify, "toxic", 0.5)


def test_quality(spark):
    classifier(spark, quality.classify, "quality", 0.3)


def pair_rows(rng, count, background):
    """Label 1 mostly where both or neither of two words stand; either alone tells nothing, and hundreds of common words tell nothing at all."""
    rows = []
    for _ in range(count):
        a, b = rng.random(2) < 0.4
        words = set((1000 + np.flatnonzero(rng.random(background) < 0.5)).tolist()) | ({1} if a else set()) | ({2} if b else set())
        rows.append((np.array(sorted(words), np.int64), int((a == b) == (rng.random() < 0.95))))
    return rows


def plain_score(m, x):
    """The machine's score by a loop over all pairs."""
    idx = m.rows_of(x)
    size = max(1, len(idx))
    z = m.bias + sum(m.w[i] for i in idx) + sum(m.v[i] @ m.v[j] / size for k, i in enumerate(idx) for j in idx[k + 1 :])
    return 1 / (1 + np.exp(-z))


def test_machine_learns_pairs_among_common_words():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(pair_rows(rng, 3000, 400), (1, 1))
    assert {1, 2} <= set(m.known.tolist())
    fresh = pair_rows(rng, 500, 400)
    assert np.mean([(plain_score(m, x) > 0.5) == y for x, y in fresh]) > 0.9  # additive weights can't pass 0.6


def test_machine_scores_by_brute_force(spark):
    docs, labels = tables(spark)
    m = toxicity.learn(docs, labels)
    texts = [r.text for r in docs.limit(40).collect()] + [t for _, t in ODD[:4]] + ["und " * 3]
    want = [plain_score(m, np.array(toxicity.terms(t or ""), np.int64)) for t in texts]
    assert len(m.known) > 50 and np.allclose(m.score([t or "" for t in texts]), want)


def test_voters_by_brute_force(spark):
    docs, labels = tables(spark)
    m = quality.learn(docs, labels, 300)
    texts = [r.text or "" for r in docs.limit(30).collect()] + ["", "12"]
    want = []
    for t in texts:
        at, value = quality.bag(t, {})
        z = sum((v * m.idf[i] * m.basis[i] for i, v in zip(at, value)), np.zeros(m.basis.shape[1]))
        norm = np.sqrt((z**2).sum())
        near = sorted(((-float(z @ other) / max(norm, 1e-9), k) for k, other in enumerate(m.z)))[: m.neighbours]
        w = [max(-c, 0) ** 4 * m.weight[k] for c, k in near]
        want.append(sum(x * m.y[k] for x, (_, k) in zip(w, near)) / sum(w) if norm > 1e-9 and sum(w) else m.prior)
    assert np.allclose(m.score(texts), want, atol=1e-4)


def test_clashing_columns_and_large_ids(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "some words of text", "en", 1, "a", "b"), (None, None, None, 2, "c", "d"), (big, "other words", "en", 3, "e", "f")], "doc_id long, text string, lang string, score int, label string, held_out string")
    labels = spark.createDataFrame([(big, 1, 0, "x"), (None, 1, 1, "y")], "doc_id long, quality int, toxic int, text string")
    for out, columns in ((toxicity.classify(docs, labels), ["doc_id", "held_out", "score", "predicted"]), (quality.classify(docs, labels), ["doc_id", "held_out", "score", "predicted"]), (langid.predict(docs), ["doc_id", "held_out", "lang_pred", "score"])):
        got = out.collect()
        assert out.columns == columns and sorted(str(r.doc_id) for r in got) == sorted([str(big), str(big), "None"])
        assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and RULE(r.doc_id)) for r in got)


def test_language(spark):
    docs, _ = tables(spark)
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [got[i].lang_pred == lang[i] for i in lang if lang[i] and got[i].held_out]
    assert np.mean(held) > 0.95
    assert [got[10**6 + k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and got[10**6 + 3].lang_pred != "und"
    assert langid.predict(docs.limit(0)).count() == 0


def test_code_lengths_are_exact():
    """The table of states against a plain escape chain, byte by byte."""
    texts = {"a": ["abracadabra abra", "a barbara"], "b": ["hocus pocus", "focus"]}
    trees = langid.Trees({k: langid.grams_of(v) for k, v in texts.items()})

    def plain(lang, text):
        counts = defaultdict(Counter)
        for t in texts[lang]:
            s = b"   " + langid.fold(t).tobytes()
            for i in range(3, len(s)):
                for k in range(4):
                    counts[s[i - k : i]][s[i]] += 1
        s, bits = b"   " + langid.fold(text).tobytes(), 0.0
        for i in range(3, len(s)):
            out, left = set(), 1.0
            for k in (3, 2, 1, 0):
                n = {c: v for c, v in counts.get(s[i - k : i], {}).items() if c not in out}
                if not n:
                    continue
                total = sum(n.values()) + len(n)
                if s[i] in n:
                    bits -= np.log2(left * n[s[i]] / total)
                    break
                left *= len(n) / total
                out |= set(n)
            else:
                bits -= np.log2(left / (256 - len(out)))
        return bits

    probe = ["abra focus", "", "zebra", "hocus " * 3, "é!"]
    want = [[plain(lang, t) for lang in ("a", "b")] for t in probe]
    assert np.allclose(trees.bits(probe), want, rtol=1e-4)


def test_tables_of_many_languages():
    texts = {f"l{k:02}": [f"{chr(97 + k) * 5} {chr(98 + k) * 3} word"] for k in range(20)}
    trees = langid.Trees({k: langid.grams_of(v) for k, v in texts.items()})
    assert len(trees.blocks) == 3
    alone = [langid.Trees({k: langid.grams_of(v)}) for k, v in texts.items()]
    assert [trees.langs[i] for i in trees.bits([v[0] for v in texts.values()]).argmin(axis=1)] == list(texts)
    assert np.allclose(np.hstack([t.bits(["aaa bbb zzz"]) for t in alone]), trees.bits(["aaa bbb zzz"]), rtol=1e-4)
