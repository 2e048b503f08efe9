import random
import zlib

import numpy as np
import pytest
from tests.llm.conftest import DOCS

from foliograph.llm import toxicity


def corpus(n=1500, seed=4):
    """Toxic where an insult and a group's name meet; either alone is clean, so no sum of weights tells them apart."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(words) for _ in range(20)] + ["vermin"] * insult + ["martians"] * group
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(insult and group)))
    return rows


def test_pairs():
    rows = corpus()
    terms = toxicity.Terms()
    found = [np.array(terms.of(t)) for _, t, _ in rows]
    y = np.array([r[2] for r in rows], float)
    machine = toxicity.train(found[:1000], y[:1000])
    scores = machine.score([t for _, t, _ in rows[1000:]], toxicity.Terms(machine.used))
    assert ((scores >= toxicity.THRESHOLD) == y[1000:]).mean() > 0.97


def test_margin_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = [0, 2, 5]
    want = 0.3 + m.weights[x].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(x) for b in x[i + 1 :])
    assert m.margin(np.array(x), np.zeros(3, int), 1)[0][0] == pytest.approx(want)


def test_documents(spark, docs, no_docs):
    rows = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(5)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(got) == len(rows) and all(got[r[0]].held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.95
    again = {r.doc_id: r.score for r in toxicity.toxicity(table.repartition(3), labels).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-9) for i, r in got.items())
    kept = {r.doc_id for r in toxicity.drop_toxic(table, labels).collect()}
    assert kept == {i for i, r in got.items() if r.score < toxicity.THRESHOLD}
    scored = toxicity.toxicity(docs, labels).collect()
    assert len(scored) == len(DOCS) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.toxicity(no_docs, labels).count() == 0 and toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_no_labels(spark, docs):
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, one).collect()} == {0}


def test_scores_keep_the_prior(spark, monkeypatch):
    """Where the sample holds as many of either label, scores are still chances at the share of all labels."""
    rng = random.Random(6)
    rows = [(i, f"{'odd' if rng.random() < (0.6 if i % 10 == 0 else 0.2) else 'even'} word{i % 7}", int(i % 10 == 0)) for i in range(4000)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 500)
    scores = toxicity.toxicity(table, labels).agg({"score": "avg"}).first()[0]
    assert abs(scores - 0.1) < 0.05


def test_repeated_keys_give_one_text(spark):
    """A chosen key that repeats brings one text to the driver, the same one in any order."""
    rows = corpus(400)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    table = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, "word1 vermin")] * 3000, "doc_id long, text string")
    once = table.dropDuplicates()
    a, b = (toxicity.fit(x, labels) for x in (table, once.repartition(3)))
    assert a.bias == b.bias and (a.used == b.used).all() and np.array_equal(a.weights, b.weights)
