import hashlib
import math

import numpy as np
import pytest

from foliograph.llm import code_compression


def lloyd(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label) that take part; plain sums in every round."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(scale * float(np.float32(x))) for x in r[1]]))
    v = np.array([[math.floor(scale * float(np.float32(x))) for x in r[1]] for r in rows]).reshape(len(rows), parts, -1)
    books = [v[:entries, p].copy() for p in range(parts)]

    def assigned(p):
        far = ((v[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = assigned(p)
            for e in np.unique(at):
                own = v[at == e, p]
                books[p][e] = own.sum(axis=0) // len(own)
    found = [assigned(p) for p in range(parts)]
    errors = sum(d for _, d in found)
    whole = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    by = {}
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + int(e)
    return sorted(str((r[0], "".join(f"{int(a[i]):02x}" for a, _ in found), int(errors[i]), by[r[2]], whole)) for i, r in enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, v int, own string").repartition(3)


def check(spark, rows, good=None, **options):
    got = code_compression.compress(frame(spark, rows), **options)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == lloyd(good or rows, **options)


def test_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 0.3, (9, 16))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 9] + rng.normal(0, 0.1, 16)], None if i % 7 == 0 else i % 3) for i in range(500)]
    check(spark, rows, entries=16)
    check(spark, rows, parts=2, entries=5, rounds=7)
    check(spark, rows, rounds=0)


def test_rows_that_take_no_part_and_ties(spark):
    good = [(1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (2, [0.5] * 8, None), (None, [-0.25] * 8, None), (3, [1e-9, -1e-9] * 4, 2), (4, [60.0, -60.0] * 4, 2)]
    bad = [(5, None, 1), (6, [None] * 8, 1), (7, [float("nan")] * 8, 1), (8, [float("inf")] * 8, 1), (9, [1.0] * 12, 1), (10, [1.0] * 7, 1), (11, [], 1)]
    check(spark, good + bad, good)
    check(spark, good + bad, good, entries=2)
    wide = code_compression.compress(frame(spark, [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)])).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in wide) == [(1, "00000000", 0), (2, "01010101", 0)]


def test_hot_label_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(code_compression, "HOT", 3)
    check(spark, [(i, [i % 5 / 8, i % 3 / 4, 0.0, 1.0], None if i % 2 else i) for i in range(60)], entries=4)
    assert code_compression.compress(frame(spark, [(1, [1.0] * 4, 1)]).where("false")).count() == 0
    with pytest.raises(ValueError):
        code_compression.compress(frame(spark, [(1, [1.0] * 4, 1)]), entries=257)


def test_deltas_are_of_changed_parts_only(spark):
    rng = np.random.default_rng(5)
    rows = frame(spark, [(i, [float(x) for x in rng.normal(0, 1, 8)], 1) for i in range(300)])
    state, books = code_compression.codebooks(rows, parts=2, entries=8, rounds=3)
    same = code_compression._assign(state, books)
    settled = code_compression._deltas(same.selectExpr("vec_id", "label", "v", "own AS old", "own"), books.shape)
    assert settled.count() == 0
    one = same.selectExpr("vec_id", "label", "v", "IF(vec_id = 7, array((own[0] + 1) % 8, own[1]), own) AS old", "own")
    got = code_compression._deltas(one, books.shape).collect()
    assert sorted((r.part, r.n) for r in got) == [(0, -1), (0, 1)]
    assert (np.array(got[0].total) == -np.array(got[1].total)).all()


def test_round_trip_gets_nearer_with_more_entries(spark):
    rng = np.random.default_rng(9)
    vectors = {i: rng.normal(0, 0.3, 8) for i in range(200)}
    rows = frame(spark, [(i, [float(x) for x in v], 1) for i, v in vectors.items()])
    far = []
    for entries in (2, 64, 200):
        state, books = code_compression.codebooks(rows, entries=entries)
        got = code_compression.decode(code_compression.encode(state, books), books).collect()
        far.append(np.mean([np.square(np.array(r.decoded) - vectors[r.vec_id]).sum() for r in got]))
    assert far[0] > far[1] > far[2] and far[2] < 1e-5


def test_wide_integers_are_exact():
    v, book = np.array([[1 << 26, -(1 << 26)]]), np.array([[(1 << 26) - 1, -(1 << 26)], [1 << 26, -(1 << 26)]])
    at, far = code_compression.nearest(v, book)
    assert at.tolist() == [1] and far.tolist() == [0]
