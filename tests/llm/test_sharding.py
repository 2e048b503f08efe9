import struct
import zlib
from collections import Counter, defaultdict
from math import log

import xxhash
from tests.llm.conftest import DOCS

from foliograph.llm import sharding
from pyspark.sql import functions as F


def brute(key, weights):
    """Spark's xxhash64 chains 8 bytes of a long and 4 of an int from seed 42; null leaves the seed."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    bids = [-log(((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11) + 0.5) / 2**53) / w for s, w in enumerate(weights)]
    return bids.index(min(bids))


def test_rows(docs):
    got = sharding.shard_table(docs, 5).collect()
    assert len(got) == len(DOCS)
    slots = defaultdict(list)
    texts = defaultdict(set)
    for i, t in DOCS:
        texts[i].add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) in texts[r.doc_id]
        assert r.shard == brute(r.doc_id, [1.0] * 5) and r.grown_shard == brute(r.doc_id, [1.0] * 6)
        assert r.grown_shard in (r.shard, 5) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(no_docs):
    assert sharding.shard_table(no_docs, 5).count() == 0


def test_weights_and_cells(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"))
    shares = Counter(r[0] for r in rows.select(sharding.rendezvous_shard(["doc_id"], [1, 2, 1])).collect())
    assert 0.47 < shares[1] / 20000 < 0.53
    ranked = sharding.gapless_rank(rows.select("doc_id", F.lit(0).alias("g"), sharding.spread("doc_id").alias("o")), ["g"], "o", 20000, 100).collect()
    order = sorted(ranked, key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(20000)) and [r["o"] for r in order] == sorted(r["o"] for r in order)
