import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from buildatlas.llm import decontaminate, packing, quality, secrets, simhash  # noqa: E402
from buildatlas.llm.queries import labels, tokenizer  # noqa: E402
from tests.llm.test_decontaminate import brute as leaks  # noqa: E402
from tests.llm.test_simhash import brute_components, brute_print  # noqa: E402
from tests.llm.test_spans import brute_secrets  # noqa: E402


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    before = rows(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert after.columns == docs.columns
            got = rows(after)
        if name == "quality":
            good = {r.doc_id for r in quality.classify(docs, labels(spark, sf_dir)).where("predicted = 1").collect()}
            assert set(got) == good and len(good) > 0.7 * len(before)
        elif name == "simhash":
            comp = brute_components([(i, brute_print(r.text)) for i, r in sorted(before.items())])
            assert set(got) == {i for i in comp if comp[i] == i}
        elif name == "decontaminate":
            bad = leaks([(i, r.text) for i, r in before.items()], [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()])
            assert set(got) == set(before) - {x[0] for x in bad}
        elif name == "secrets":
            assert set(got) == set(before)
            for i, r in got.items():
                assert not brute_secrets(r.text) and r.n_chars == len(r.text) if brute_secrets(before[i].text) else r == before[i]
        else:
            placed(after, before)
        docs, before = after, got
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def placed(result, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in result.collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for of in sequences.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(pieces) == set(docs)
    for i, of in pieces.items():
        ids = plain.encode(docs[i].text or "", add_special_tokens=False).ids + [2]
        of.sort(key=lambda r: r.piece)
        assert [r.piece for r in of] == list(range(len(of))) and len(of) == -(-len(ids) // 1024)
        at = 0
        for r in of:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == len(ids)
    assert len(sequences) <= -(-sum(r.length for of in pieces.values() for r in of) // 1024) + 2


def test_packing_cases(spark):
    texts = [None, "", "a  b \n c", "<|endoftext|> x", "word " * 5000, "é\xa0 z   "]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    result = packing.pack(docs, tokenizer())
    placed(result, {r.doc_id: r for r in docs.collect()})
    assert packing.pack(docs.limit(0), tokenizer()).count() == 0


def test_stages_take_clashing_columns_and_nulls(spark, sf_dir):
    data = [(1, "password=hunter2hunter2 " + "fine words here " * 20, "en", None, None, "x"), (None, None, None, None, 3, "y"), (1, "password=hunter2hunter2 " + "fine words here " * 20, "en", None, None, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    for out in (quality.keep(docs, spark.createDataFrame([], "doc_id long, quality int")), decontaminate.clean(docs, items), secrets.mask(docs)):
        assert out.columns == docs.columns and out.count() == 3
    assert simhash.keep(docs).count() == 2


def test_packing_keeps_large_null_and_repeated_ids(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a b"), (None, "c"), (big, "other"), (None, None)], "doc_id long, text string")
    got = packing.pack(docs, tokenizer()).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1152921504606846977", "1152921504606846977", "None", "None"] and len({(r.sequence_id, r.offset) for r in got}) == 4


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_workers_hold_few_texts_at_a_time(spark, monkeypatch):
    """The passes over texts, each fed all rows as one batch: what Python holds stays far below the texts' size."""
    n, text = 4000, ("w" * 99 + " ") * 200
    docs = spark.range(n).selectExpr("id AS doc_id", f"concat(repeat('{text[:100]}', 200), id) AS text")
    known = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    passes, whole = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **b: passes.append((self, f)) or whole(self, f, schema, *a, **b))
    quality.keep(docs, known)
    quality.classify(docs, known)
    simhash.fingerprints(docs)
    packing.pieces(docs, tokenizer())
    assert len(passes) == 4
    for df, f in passes:
        batch = df.toArrow().combine_chunks().to_batches()[0]
        assert batch.num_rows == n
        tracemalloc.start()
        rows = sum(b.num_rows for b in f(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows >= n and most < n * len(text) / 2


def test_words_not_remembered_score_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    voters, texts = quality.learn(docs, labels(spark, sf_dir)), [r.text or "" for r in docs.collect()]
    want = voters.score(texts)
    monkeypatch.setattr(quality, "REMEMBERED", 10)
    voters.__dict__.pop("_known")
    assert voters.score(texts).tolist() == want.tolist() and len(voters.__dict__["_known"]) < 2000
