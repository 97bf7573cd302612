import numpy as np
import pytest

from buildatlas.llm import embeddings


def brute(rows):
    ok = [i for i, (_, e, y) in enumerate(rows) if y is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    comp = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        comp[i] = min(rows[k][0] for k in seen)
    return sorted((rows[i][0], len(links[i]), comp[i], rows[i][0] == comp[i]) for i in range(len(rows)))


@pytest.mark.parametrize("blocks", [(4000, 16000), (7, 11)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(embeddings, "HOMES", blocks[0])
    monkeypatch.setattr(embeddings, "VISITORS", blocks[1])
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        base = rng.normal(size=24)
        for _ in range(40 if g == 0 else rng.integers(1, 8)):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.choice([0, 0.1, 0.25, 0.35])).astype(np.float32).tolist(), int(g % 3)))
    bad = [None, [], [0.0] * 24, [1.0] * 23 + [None], [1.0] * 23 + [float("nan")], [1.0] * 23 + [float("inf")]]
    rows += [(1000 + i, e, 1) for i, e in enumerate(bad)] + [(1100, rows[0][1], None), (1101, rows[0][1], 0), (1102, rows[0][1], 0), (1103, [1.0, 2.0], 0), (1104, [2.0, 4.0], 0)]
    frame = spark.createDataFrame([(*r, 7, "x", r[0], 0) for r in rows], "vec_id long, embedding array<float>, label int, cid long, a string, component_id long, e int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.linked(frame).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
