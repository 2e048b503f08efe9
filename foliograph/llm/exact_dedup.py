"""Exact deduplication by two-pass Bloom filtering, all in DataFrame functions.

Pass 1 counts 64-bit hashes of the texts; each task combines its own first, so a row moves 8 bytes at most, and no text
moves. (Bitmaps per task would be larger: 16 bits for each row of the whole table, from every task.) The hashes that
repeat are the Bloom filter: 16 slots each, two bits, up to MAX_SLOTS, so its bitmaps are broadcast under a fixed bound.
Pass 2 tests every row: one that misses either bit is certainly unique and passes straight through; only the others
shuffle, to be grouped exactly by SHA-256. Past MAX_SLOTS / 16 texts that repeat more rows shuffle; results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import materialize

#: The filter's bound: 2^29 slots are 64 MB of bitmaps.
MAX_SLOTS = 1 << 29
#: Bits of one bitmap row, as bitmap_construct_agg makes them.
BITMAP_BITS = 32768
#: Groups that hold over 1/HOT of the rows are broadcast; there are fewer than HOT of them.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _slots(hashed: Column, slots: int) -> list[Column]:
    """Two slots of a hash; both are 0-based and even in the slots."""
    return [F.pmod(F.xxhash64(hashed, F.lit(seed)), F.lit(slots)) for seed in (1, 2)]


def repeated(rows: DataFrame, hashed: str) -> DataFrame:
    """hashed, n of the values that several rows have; materialised."""
    return materialize(rows.groupBy(hashed).agg(F.count("*").alias("n")).where("n > 1"), "repeated")


def filter_of(values: DataFrame, hashed: str, count: int) -> tuple[DataFrame, int]:
    """The Bloom filter of `count` values: rows of bucket, bitmap, and its slots."""
    slots = min(MAX_SLOTS, -(-max(1, 16 * count) // BITMAP_BITS) * BITMAP_BITS)
    each = values.select(F.explode(F.array(*_slots(F.col(hashed), slots))).alias("slot"))
    bits = each.groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap"))
    return materialize(bits, "filter"), slots


def _has_bit(bitmap: Column, slot: Column) -> Column:
    at = (slot % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))


def tested(rows: DataFrame, hashed: str, bits: DataFrame, slots: int, flag: str = "_maybe") -> DataFrame:
    """Adds flag: whether the filter may hold `hashed`. bits has at most MAX_SLOTS / BITMAP_BITS rows of 4 KB."""
    first, second = _slots(F.col(hashed), slots)
    out = rows.withColumns({"_s1": first, "_s2": second})
    for n in (1, 2):
        side = bits.select(F.col("bucket").alias(f"_b{n}"), F.col("bitmap").alias(f"_m{n}"))
        out = out.withColumn(f"_b{n}", F.expr(f"_s{n} div {BITMAP_BITS}")).join(F.broadcast(side), f"_b{n}", "left")
    maybe = _has_bit(F.col("_m1"), F.col("_s1")) & _has_bit(F.col("_m2"), F.col("_s2"))
    return out.select(*rows.columns, maybe.alias(flag))


def _first_pass(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """Keys, hashes and digests of all rows, the filter and its slots. The texts are read here, and not again by dedup_decisions."""
    body = normal_text(F.col(text))
    digests = materialize(docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("_h"), F.sha2(body, 256).alias("text_sha256")), "digests")
    often = repeated(digests, "_h")
    return digests, *filter_of(often, "_h", often.count())


def _grouped(maybe: DataFrame, rows: int) -> DataFrame:
    """One row per digest and key of the possibly repeated rows, with _h, _copies, keep_id and group_size."""
    maybe = materialize(maybe.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("_copies"), F.any_value("_h").alias("_h")), "maybe")
    groups = materialize(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("_copies").alias("group_size"), F.count("*").alias("_ids")), "groups")
    limit = -(-max(1, rows) // HOT)
    hot = F.broadcast(groups.where(F.col("_ids") > limit).drop("_ids"))
    cold = groups.where(F.col("_ids") <= limit).drop("_ids")
    return maybe.join(hot, "text_sha256").unionByName(maybe.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(cold, "text_sha256"))


def dedup_decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest key stays;
    a null key is smaller than any. If rows repeat both text and key, one of them is kept. Columns of docs but key and
    text are ignored; an empty table gives no rows. Equality of SHA-256 counts as equality.
    """
    digests, bits, slots = _first_pass(docs, key, text)
    each = tested(digests, "_h", bits, slots)
    unique = each.where("NOT _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    each = _grouped(each.where("_maybe"), digests.count()).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return unique.unionByName(each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that dedup_decisions keeps, with all their columns; of rows that repeat text and key, any one.

    Rows that miss the filter pass straight through. Of the others, a second filter, of the texts and keys that stay, lets
    only these shuffle (and few others): copies go where they are read. Both filters test a 64-bit hash of the text; the
    digest is worked out for what shuffles. Null texts, repeated rows and an empty table as in dedup_decisions.
    """
    digests, bits, slots = _first_pass(docs, key, text)
    kept = _grouped(tested(digests, "_h", bits, slots).where("_maybe"), digests.count()).where("doc_id <=> keep_id").select(F.col("doc_id").alias("_keep"), "text_sha256", "_h")
    kept = materialize(kept.withColumn("_who", F.xxhash64("_h", "_keep")), "kept")
    few, room = filter_of(kept, "_who", kept.count())
    body = docs.select(F.struct("*").alias("_row"), F.col(key).cast("long").alias("_key"), F.xxhash64(normal_text(F.col(text))).alias("_h"))
    body = tested(body, "_h", bits, slots)
    stay = tested(body.where("_maybe").withColumn("_who", F.xxhash64("_h", "_key")), "_who", few, room, "_stays").where("_stays")
    stay = stay.withColumn("text_sha256", F.sha2(normal_text(F.col("_row")[text]), 256))
    stay = stay.join(kept, [stay["text_sha256"] == kept["text_sha256"], stay["_key"].eqNullSafe(kept["_keep"])], "left_semi")
    stay = stay.groupBy("text_sha256", "_key").agg(F.any_value("_row").alias("_row"))
    return body.where("NOT _maybe").select("_row.*").unionByName(stay.select("_row.*"))
