import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS

from foliograph.llm import simhash
from foliograph.llm.common import smallest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, width=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, link):
    prints = list(dict.fromkeys(prints))
    root = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= link:
                x, y = root[a], root[b]
                root = {p: min(x, y) if r in (x, y) else r for p, r in root.items()}
    return root


@given(st.text(alphabet="Ab cÄ\t\n", max_size=40))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) & (2**64 - 1) == brute_print(text)


def near_prints(seed, clusters=40, each=12):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 2**63, clusters, dtype=np.uint64) * 2:
        for _ in range(each):
            flips = rng.integers(0, 64, rng.integers(0, 7))
            out.append(int(c) ^ sum({1 << int(b) for b in flips}))
    return sorted(set(out))


def test_parts():
    """Any 4 flipped bits leave one part within its own link; the parts cover all bits once."""
    for link in range(8):
        parts = simhash.parted(link)
        assert sum(mask for mask, _ in parts) == 2**64 - 1 and sum(own + 1 for _, own in parts) == link + 1
        rng = np.random.default_rng(link)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, link, replace=False))
            assert any((flips & mask).bit_count() <= own for mask, own in parts)


def test_leaf_and_tree():
    for seed in range(3):
        prints = near_prints(seed)
        want = brute_classes(prints, 4)
        fps = np.array(prints, np.uint64)
        for depth in (0, 3):
            root = {p: p for p in prints}
            for mask, link in simhash.parted(4):
                points, radii = simhash.plant(fps, depth, mask, link)
                leaf, at = simhash.routed(fps & np.uint64(mask), points, radii, depth, link)
                for n in np.unique(leaf):
                    own = fps[np.unique(at[leaf == n])]
                    for a, b in zip(*simhash.leaf_links(own, 4), strict=True):
                        x, y = root[int(own[a])], root[int(own[b])]
                        root = {p: min(x, y) if r in (x, y) else r for p, r in root.items()}
            assert root == want


def test_visits_grow_slowly(spark):
    """Random fingerprints: a tree planned for 64 times as many has several levels more and few visits more."""
    rng = np.random.default_rng(4)
    fps = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63, 20_000)], "fp long")
    each = [simhash.visits(fps, n, 4).count() / 20_000 for n in (1, 16 * simhash.LEAF, 1024 * simhash.LEAF)]
    assert each[0] == 3 and each[1] < 8 and each[2] < 18


def test_large_leaf_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 90)
    test_spark_classes(spark)


def test_spark_classes(spark):
    prints = near_prints(9)
    want = brute_classes(prints, 4)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in simhash.classes(simhash.linked(fps, 500_000, 4)).collect()}  # planned as for more: a deep tree
    groups, got = {}, {}
    for p, s in zip(prints, signed, strict=True):
        groups.setdefault(want[p], set()).add(p)
        got.setdefault(roots.get(s, s), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_chain_of_many_rounds(spark):
    edges = spark.range(1, 300).selectExpr("id AS u", "id - 1 AS v")
    assert {r.root for r in simhash.classes(edges).collect()} == {0}


def test_documents(docs, no_docs):
    got = simhash.near_duplicates(docs, width=4, link=4).collect()
    assert len(got) == len(DOCS)
    prints = [brute_print(t) for _, t in DOCS]
    roots = brute_classes(prints, 4)
    first = {}
    for (i, _), p in zip(DOCS, prints, strict=True):
        first.setdefault(roots[p], []).append(i)
    want = sorted((str(i), f"{p:016x}", str(min((x for x in first[roots[p]] if x is not None), default=None))) for (i, _), p in zip(DOCS, prints, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_drop(docs, no_docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 5, 7, 7, None, None, 8, 9, 10, 12]))
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_smallest(spark):
    """The bounded sample is that of smallest hash, however many rows are left off before the sort."""
    hashed = F.xxhash64("id")
    want = [r.id for r in spark.range(5000).orderBy(hashed).limit(100).collect()]
    assert [r.id for r in smallest(spark.range(5000), hashed, 100, 5000).collect()] == want
    assert smallest(spark.range(7), hashed, 100, 7).count() == 7 and smallest(spark.range(0), hashed, 100, 0).count() == 0
