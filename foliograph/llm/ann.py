"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is rotated by a fixed random rotation and only the signs are packed; its norm and the inner product of its
direction with its code are kept as correction scalars. A query's rotated components are cut to four bits, so that its
inner product with a code is a few population counts of packed bits; from it the inner product is estimated without bias,
with an error of about EPSILON standard deviations at most. In a block, only vectors whose upper bound reaches the k-th
largest lower bound are scored exactly. Queries meet all rows in bounded blocks; a block returns k rows a query. Vectors
travel with their blocks: at 64 components bounds leave between a hundredth and a third of the rows as candidates, and
joining these by themselves would move many more bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliograph.llm.common import materialize

#: Standard deviations of the estimate's error that the bounds allow for.
EPSILON = 1.9
#: Bits of a query's rotated component.
LEVELS = 4
#: Rows and queries that meet in one block at most, and rows in one at least where there are tasks for more blocks.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_ROWS = 65_536, 16_384, 2_048
#: Estimates that are held at a time.
HELD = 1 << 21
INDEX_SCHEMA = "vec_id long, dim int, code binary, norm double, fit double, vector {}"


def rotated(vectors: np.ndarray, seed: int = 7) -> np.ndarray:
    """The vectors, filled up with zeros to a power of two, after three rounds of random signs and a Hadamard transform."""
    size = 1 << max(3, (vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), size))
    out[:, : vectors.shape[1]] = vectors
    for signs in np.random.default_rng(seed).choice((-1.0, 1.0), (3, size)):
        out *= signs
        half = 1
        while half < size:
            pairs = out.reshape(len(out), -1, 2, half)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(out), size)
            half *= 2
        out /= np.sqrt(size)
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms, and the inner products of unit vectors with their unit codes."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    turned = rotated(vectors / norms[:, None])
    return _packed(turned > 0), norms, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimate(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by rows) and the error bounds at EPSILON."""
    turned = rotated(queries)
    dim = turned.shape[1]
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << LEVELS) - 1), 1e-300)
    cut = np.rint((turned - low) / step).astype(np.uint8)
    inside = np.zeros((len(queries), len(codes)), np.float32)
    for level in range(LEVELS):
        plane = _packed(cut >> level & 1)
        for word in range(codes.shape[1]):
            inside += np.bitwise_count(plane[:, word, None] & codes[None, :, word]) * np.float32(1 << level)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    signed = 2 * (step * inside + low * ones) - (step * cut.sum(axis=1, keepdims=True) + low * dim)
    scale = norms / (fit * np.sqrt(dim))
    lengths = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    around = lengths * np.sqrt(np.maximum(0, 1 - fit * fit)) / np.sqrt(max(1, dim - 1)) + step / np.sqrt(12)
    return signed * scale, around * (EPSILON * norms / fit)


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index of all rows: codes, correction scalars and the vectors.

    Vectors that are null, zero or empty, or hold null or non-finite components, take no part, nor do rows of null key.
    Vectors of another length are indexed beside the others, and meet queries of their own length only. Repeated rows are
    all indexed, other columns ignored; an empty table gives an empty index.
    """
    kind = vectors.select(vector).schema[0].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"  # floats are exact in double precision
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
                scale = np.abs(own).max(axis=1, initial=1e-300)[:, None]  # keeps squares of very small and large numbers finite
                codes, norms, fit = encode(own / scale)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(own), dim, np.int32)), packed, pa.array(norms * scale[:, 0]), pa.array(fit), part.column(1)], ["vec_id", "dim", "code", "norm", "fit", "vector"])

    return materialize(rows.mapInArrow(run, INDEX_SCHEMA.format(f"array<{kind}>")), "index")


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(float)


def _search(some: pa.Table, wanted: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id, score: of each wanted query the k best rows of some."""
    out: list[list[np.ndarray]] = [[], [], []]
    if len(some) and len(wanted):
        ids, vectors = _columns(some)
        codes = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
        norms, fit = some.column("norm").to_numpy(), some.column("fit").to_numpy()
        names, asked = _columns(wanted)
        many = max(1, HELD // len(ids))
        for at in range(0, len(names), many):
            guess, around = estimate(asked[at : at + many], codes, norms, fit)
            for i, name in enumerate(names[at : at + many]):
                other = ids != name
                low = (guess[i] - around[i])[other]
                least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                own = np.flatnonzero(other & ~(guess[i] + around[i] < least))
                score = (vectors[own] * asked[at + i]).sum(axis=1)
                best = np.lexsort((ids[own], -score))[:k]
                out[0].append(np.full(len(best), name))
                out[1].append(ids[own][best])
                out[2].append(score[best])
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(np.concatenate(x) if x else [], kind) for x, kind in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])


def nearest(indexed: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row of queries (rows of an index).

    Largest inner product first, ties to the smaller vec_id; all rows of the query's length count but those of its own
    key. Of queries that repeat a key, the one of smallest vector is taken. With at most k rows all return. An empty table
    or no query gives no rows.
    """
    rows = indexed.count()
    asked = materialize(queries.groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("q")).select("vec_id", "q.*"), "queries")
    count = asked.count()
    many = max(1, -(-count // BLOCK_QUERIES))
    spare = 2 * indexed.sparkSession.sparkContext.defaultParallelism // many
    dealt = max(1, -(-rows // BLOCK_ROWS), min(spare, -(-rows // LEAST_ROWS)))
    turn_of = F.pmod(F.monotonically_increasing_id(), F.lit(dealt)).alias("g")
    left = indexed.select("*", turn_of).select("*", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("j"))
    right = asked.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(many)).cast("int").alias("j"))
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dealt - 1).cast("long"))).alias("g"))

    def search(some: pa.Table, wanted: pa.Table) -> pa.Table:
        return _search(some, wanted, k)

    found = left.groupBy("dim", "g", "j").cogroup(right.groupBy("dim", "g", "j")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
