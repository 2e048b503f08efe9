import math

import numpy as np

from foliograph.llm import ann


def brute(ids, vectors, query, k):
    score = (vectors * vectors[query]).sum(axis=1)
    return [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score)) if ids[i] != ids[query]][:k]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 48)).astype(np.float32)
    vectors[100:400] = vectors[0]  # one very frequent vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    index = ann.index(frame(spark, rows))
    got = {}
    for r in ann.nearest(index, index.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids, exact, hits = np.arange(1500), vectors.astype(float), 0
    assert len(got) == 75
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        order = [found[n] for n in range(1, 21)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        want = brute(ids, exact, q, 20)
        hits += len({i for i, _ in want} & {i for i, _ in order})
        for i, s in order:
            assert math.isclose(s, float((exact[i] * exact[q]).sum()), rel_tol=1e-12, abs_tol=1e-12)
    assert hits / (75 * 20) > 0.97


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1e30, 1e30]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [])]
    rows += [(9, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0]), (60, [5.0] * 5000), (80, [0.25, 0.0]), (80, [0.0, 0.5])]
    index = ann.index(frame(spark, rows))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(index, index.where("vec_id % 20 = 0"), 20).collect())
    big = float(np.float32(1e30))
    assert got == [
        (0, 1, 20, big), (0, 2, 7, 0.5), (0, 3, 7, 0.5), (0, 4, 80, 0.25), (0, 5, 80, 0.0), (20, 1, 0, big), (20, 2, 7, big), (20, 3, 7, big), (20, 4, 80, big * 0.5), (20, 5, 80, big * 0.25),
        (40, 1, 9, 6.0), (80, 1, 20, big * 0.5), (80, 2, 7, 0.25), (80, 3, 7, 0.25), (80, 4, 0, 0.0),
    ]
    assert ann.nearest(ann.index(frame(spark, rows).where("false")), index.where("false")).count() == 0


def test_bounds():
    rng = np.random.default_rng(2)
    for dim, words in ((64, 1), (48, 1), (100, 2), (3, 1)):
        x, q = rng.standard_normal((4000, dim)), rng.standard_normal((50, dim))
        codes, norms, fit = ann.encode(x)
        assert codes.shape == (4000, words) and np.allclose((ann.rotated(x) @ ann.rotated(q).T), x @ q.T)
        guess, around = ann.estimate(q, codes, norms, fit)
        assert (np.abs(guess - q @ x.T) <= around).mean() > 0.9
        assert abs((guess - q @ x.T).mean()) < 0.1
