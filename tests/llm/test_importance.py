import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from tests.llm.conftest import DOCS

from foliograph.llm import importance

TARGET = [(1, "the quick brown fox"), (2, "lorem ipsum lorem"), (3, None)]


def features(text, low, high):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 1000 for n in range(low, high + 1) for i in range(len(words) - n + 1))


def brute(docs, target, low, high, least, percent):
    held = [(i, *features(t, low, high)) for i, t in docs]
    s, t = Counter(), Counter()
    for *_, f in held:
        s.update(f)
    for _, x in target:
        t.update(features(x, low, high)[1])
    big, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + 1000) / ((s[b] + 1) * (goal + 1000)))) for b in range(1000)]
    rows = []
    for i, words, f in held:
        n = sum(f.values())
        weight = sum(gain[b] * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0], r[2], r[3]))
    drawn = [(*r, k + 1) for k, r in enumerate(order) if k < percent * len(order) // 100]
    rest = Counter(map(tuple, rows)) - Counter(tuple(r[:5]) for r in drawn)
    return sorted([str((r[0], *r[2:])) for r in drawn] + [str((r[0], *r[2:], None)) for r in rest.elements()])


def check(spark, docs, low, high, least, percent, frame=None):
    frame = frame if frame is not None else spark.createDataFrame(docs, "doc_id long, text string")
    got = importance.resample(frame, spark.createDataFrame(TARGET, "item_id long, text string"), low, high, buckets=1000, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(docs, TARGET, low, high, least, percent)


def test_against_brute_force(spark, docs):
    check(spark, DOCS, 1, 1, 2, 50, docs)
    check(spark, DOCS, 1, 3, 1, 100, docs)


def test_long_texts_are_counted_by_pieces(spark, monkeypatch):
    counter = importance.Counter(1, 3, 1000)
    text = "".join(f"Wörd{i % 37}  x{i % 11}-" for i in range(900))
    monkeypatch.setattr(importance, "CHUNK", 500)
    assert len(list(counter.pieces(text))) > 5
    total = np.zeros(1000, int)
    for skip, piece in counter.pieces(text):
        _, bucket, n = counter.of([(0, skip, piece)])
        total[bucket] += n
    assert {b: n for b, n in enumerate(total) if n} == features(text, 1, 3)[1]


def test_ties_and_shares(spark):
    docs = [(i, "one two three four") for i in (5, 3, 3, 9, 1, 7, None, 4, 2, 8)]
    check(spark, docs, 1, 2, 4, 40)
    check(spark, docs, 1, 1, 5, 40)


def test_empty(spark, no_docs):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    assert importance.resample(no_docs, target).count() == 0
    rows = importance.resample(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), target.where("false"), least_words=1, percent=100).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in rows] == [(1, 3, 1)]


def test_sample_keeps_columns(spark, docs):
    ranked = importance.resample(docs, spark.createDataFrame(TARGET, "item_id long, text string"), least_words=2, percent=30)
    keys = {r.doc_id for r in ranked.where("rank IS NOT NULL").collect()}
    got = importance.sample(docs, ranked)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == keys
