import numpy as np

from foliograph.llm import simhash


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, at):
    out = list(words)
    for i in at:
        out[i] = f"new{rng.integers(1 << 40)}"
    return out


def classes(texts, limit=0.8):
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= limit and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


def told(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_limit_is_exact(spark):
    """Pairs just above and below 0.8, many of which an estimate of 512 bits would tell wrongly."""
    rng = np.random.default_rng(8)
    texts, above = [], []
    for i in range(160):
        words = [f"w{x}" for x in rng.integers(0, 9000, 204)]
        other = edited(rng, words, range(5, 5 + 7 * (4 + i % 2), 7))  # 4 or 5 words apart: 20 or 25 of 200 shingles
        texts += [" ".join(words), " ".join(other)]
        above.append(jaccard(*texts[-2:]) >= 0.8)
    assert 0 < sum(above) < len(above) and all(abs(jaccard(*texts[2 * i : 2 * i + 2]) - 0.8) < 0.04 for i in range(160))
    assert told(spark, texts) == [j - j % 2 if above[j // 2] else j for j in range(len(texts))]


def test_large_groups(spark):
    """Groups whose shingles are in more than FEW texts: near copies, chains, and unlike texts around one passage."""
    rng = np.random.default_rng(2)
    texts = []
    for size in (40, 14):
        base = [f"b{x}" for x in rng.integers(0, 9000, 60)]
        texts += [" ".join(edited(rng, base, rng.choice(60, rng.integers(0, 4), replace=False))) for _ in range(size)]
    chain = [f"c{x}" for x in rng.integers(0, 9000, 120)]
    texts += [" ".join(chain[i : i + 90]) for i in range(0, 30, 3)]
    passage = [f"p{x}" for x in range(40)]
    texts += [" ".join(passage + [f"u{rng.integers(1 << 40)}" for _ in range(k)]) for k in (2, 3, 5, 8, 12, 20, 30, 40, 50, 60, 70, 80)]
    texts += ["", " ", "one", "one two"]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    want = classes(texts)
    assert len(set(want)) > 15
    assert told(spark, texts) == want


def test_rows_are_dropped_by_their_own_text(spark):
    """A near copy with a null or repeated key takes no unrelated row of that key along."""
    rng = np.random.default_rng(4)
    base, *alone = ([f"d{x}" for x in rng.integers(0, 9000, 80)] for _ in range(6))
    copies = [" ".join(edited(rng, base, [i])) for i in range(3)]
    alone = [" ".join(x) for x in alone]
    rows = [(5, copies[0]), (None, copies[1]), (7, copies[2]), (None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (5, alone[4]), (5, copies[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in rows if r[1] not in copies[1:]]))


def test_parities_bound_what_differs():
    rng = np.random.default_rng(2)
    for n in (1, 30, 400, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        b = np.concatenate((a[n // 10 :], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)))
        apart = len(np.setxor1d(a, b))
        flipped = np.bitwise_count((simhash.parity(np.unique(a)) ^ simhash.parity(np.unique(b))).view(np.uint64)).sum()
        assert flipped <= apart and (n > 100 or flipped >= apart // 2)


def spied(monkeypatch, name, told):
    real = getattr(simhash, name)

    def spy(*args):
        told.append(args)
        return real(*args)

    monkeypatch.setattr(simhash, name, spy)


def test_simhash_trees_find_pairs(spark, monkeypatch):
    """Pairs that the vantage-point trees link are compared, whatever shingles of their heads others share."""
    trees, compared = [], []
    spied(monkeypatch, "linked", trees)
    spied(monkeypatch, "_verified", compared)
    rng = np.random.default_rng(6)
    base = [f"s{x}" for x in rng.integers(0, 9000, 900)]
    texts = [" ".join(base), " ".join(edited(rng, base, [400])), *(" ".join(f"u{x}" for x in rng.integers(0, 1 << 40, 30)) for _ in range(9))]
    assert told(spark, texts) == [0, 0, *range(2, 11)]
    fps = trees[0][0]
    assert len(trees) == 1 and trees[0][2] == simhash.LINK and fps.count() == len(texts)
    sets = [simhash.shingle_set(t, 5) for t in texts]
    assert {r.fp for r in fps.collect()} == {simhash.simhash_of([s]) for s in sets}
    one, two = (simhash.simhash_of([s]) & ((1 << 64) - 1) for s in sets[:2])
    assert (one ^ two).bit_count() <= simhash.LINK
    pairs = simhash._simhash_pairs(compared[0][1])
    u, v = sorted(int(np.uint64(simhash.xxhash.xxh64_intdigest(s.tobytes(), 42)).astype(np.int64)) for s in sets[:2])
    assert {tuple(r) for r in pairs.collect()} == {(u, v)}


def test_group_near_the_limit_meets_few_pairs(spark, monkeypatch):
    """Copies of one text, on either side of the limit from one another, become one class before all that are left meet."""
    compared = []
    spied(monkeypatch, "_verified", compared)
    rng = np.random.default_rng(9)
    base = [f"b{x}" for x in rng.integers(0, 9000, 150)]
    texts = [" ".join(edited(rng, base, rng.choice(150, rng.integers(2, 5), replace=False))) for _ in range(260)]
    assert told(spark, texts) == classes(texts)
    met = [args[0].count() for args in compared]
    assert sum(met) < 10 * len(texts)
