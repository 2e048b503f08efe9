import hashlib
from collections import defaultdict

from tests.llm.conftest import DOCS

from foliograph.llm import exact_dedup
from pyspark.sql import functions as F


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_decisions(docs, no_docs):
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[normal(t)].append(i)
    want, seen = [], set()
    for i, t in DOCS:
        own = groups[normal(t)]
        keep = max((x for x in own if x is not None), default=None)
        first = (i, normal(t)) not in seen
        seen.add((i, normal(t)))
        want.append((str(i), str(keep), len(own), i == keep and first, hashlib.sha256(normal(t).encode()).hexdigest()))
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup_decisions(docs).collect()]
    assert sorted(got) == sorted(want)
    assert exact_dedup.dedup_decisions(no_docs).count() == 0


def test_only_ascii_is_lowered(spark):
    docs = spark.createDataFrame([(1, "ÀA"), (2, "àa"), (3, "Àa")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.dedup_decisions(docs).collect()} == {(1, 3), (2, 2), (3, 3)}


def test_drop(docs, no_docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [4, 6, 7, None, 8, 9, 10, 11, 12]))
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_hot_group_and_full_filter(spark, monkeypatch):
    """A third of the rows are one text; a filter of 32768 slots is full, so nearly all rows are grouped: same result."""
    monkeypatch.setattr(exact_dedup, "MAX_SLOTS", exact_dedup.BITMAP_BITS)
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("long"))).alias("text"))
    got = exact_dedup.dedup_decisions(docs)
    want = docs.groupBy("text").agg(F.max("doc_id").alias("k"), F.count("*").alias("n")).join(docs, "text").selectExpr("doc_id", "k AS keep_id", "n AS group_size", "doc_id = k AS kept")
    assert got.drop("text_sha256").exceptAll(want).count() == 0 and got.count() == 30000
    stays = got.where("kept").select("doc_id")
    assert exact_dedup.drop_copies(docs).select("doc_id").exceptAll(stays).count() == 0 and stays.count() == exact_dedup.drop_copies(docs).count()


def test_filter_lets_unique_rows_pass(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "concat('text ', least(id, 19990)) AS text")
    digests, bits, slots = exact_dedup._first_pass(docs, "doc_id", "text")
    assert 10 <= exact_dedup.tested(digests, "_h", bits, slots).where("_maybe").count() < 200
