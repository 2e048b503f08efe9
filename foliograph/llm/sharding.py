"""Rendezvous (highest random weight) hashing of stable record keys over weighted shards.

Each shard bids -ln(u)/weight for a key, where u in (0, 1) is a hash of key and shard; the lowest bid wins. A
shard's share is its weight's share. A new shard only takes keys that it wins, so no row moves between old shards.
Everything is a JVM expression: assigning shards needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import gapless_rank, materialize, spread


def _bid(key: list[Column], shard: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(*key, shard), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(unit) / weight


def rendezvous_shard(keys: Sequence[Column | str], weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that bids lowest for the keys; on equal bids the smaller. Null keys are a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = [F.col(k) if isinstance(k, str) else k for k in keys]
    bids = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, i: F.struct(_bid(key, i, w).alias("bid"), i.alias("shard")))
    return F.array_min(bids)["shard"]


def shard_table(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its shard, its place there, and its shard if there were one more.

    Law `key`: key and shard count decide. size is UTF-8 bytes plus 16; null text counts as no bytes and has the
    checksum of the empty text. Repeated rows each get a slot; a null key is a key like any other; columns of docs
    but key and text are ignored, whatever their names; an empty table gives no rows. slot is the rank in the shard
    by a hash of the key, built from many small cells, so no task sorts a shard; rows of one key share a cell, so those of a
    key that repeats very often are ranked by one task (two numbers a row).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    equal = [1.0] * shards
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body).alias("text_crc32"),
        rendezvous_shard([key], equal).alias("shard"), rendezvous_shard([key], [*equal, 1.0]).alias("grown_shard"), spread(key, F.lit(1)).alias("_order"),
    )
    rows = materialize(rows, "shards")
    ranked = gapless_rank(rows, ["shard"], "_order", -(-rows.count() // shards))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("rank").alias("slot"), "grown_shard")
