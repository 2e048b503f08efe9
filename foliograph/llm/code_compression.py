"""Vector code compression: codebooks of vector parts by Lloyd's method, maintained by deltas.

Vectors become integers and are cut into parts; each part position has a codebook. The table of integer vectors carries
each part's previous assignment, and the codebooks' running sums and counts are a table of their own. A round assigns every
part where it lies; only parts whose assignment changed contribute, minus to the old entry and plus to the new one. A task
sums its own contributions first, so that it sends at most one row per entry, and nothing where nothing changed. Running
sums are integers, so that deltas and sums from scratch agree exactly whatever the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import drop_tables, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are held within this, so that distances and their sums fit 64 bits.
WIDEST = 1 << 26
#: Distances are kept for so many pairs of part and entry at a time.
HELD = 1 << 21
#: Groups that hold over 1/HOT of the rows are broadcast; there are fewer than HOT of them.
HOT = 1000


def integers(vectors: DataFrame, parts: int, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, v of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("_v"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("_v").isNotNull() & ~bad & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    cut = F.transform("_v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-WIDEST))), F.lit(float(WIDEST)))).cast("int"))
    return rows.select("vec_id", "label", cut.alias("v"))


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts (n, width) the nearest entries, ties to the lower index, and the squared distances. Exact."""
    at, far = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    widest = max(1, int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * v.shape[1] * widest * widest < 1 << 53 else np.int64  # doubles hold these integers exactly
    entries, step = book.astype(kind), max(1, HELD // len(book))
    squares = (entries * entries).sum(axis=1)
    for lo in range(0, len(v), step):
        own = v[lo : lo + step].astype(kind)
        part = squares - 2 * (own @ entries.T)
        best = part.argmin(axis=1)
        at[lo : lo + step] = best
        far[lo : lo + step] = part[np.arange(len(own)), best] + (own * own).sum(axis=1)
    return at, far


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _batches(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with their vectors by part, previous assignments, and new ones with their squared distances."""
    parts, _, width = books.shape
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
            found = [nearest(v[:, p], books[p]) for p in range(parts)]
            old = _matrix(batch.column("own"), parts) if "own" in batch.schema.names else np.full((len(v), parts), -1, np.int32)
            yield batch, v, old, np.stack([a for a, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _assign(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The state with its parts' next assignments in `now`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, old, now, _ in _batches(batches, books):
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), x.shape[1]).cast(pa.list_(pa.int32())) for x in (old, now)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("vec_id", "label", "v")), *lists], ["vec_id", "label", "v", "old", "own"])

    kind = state.schema["label"].dataType.simpleString()
    rows = state.select(*[c for c in state.columns if c != "old"])
    return rows.mapInArrow(run, f"vec_id long, label {kind}, v array<int>, old array<int>, own array<int>")


def _deltas(moved: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """part, entry, n, total: what changed parts take from their old entries and bring to their new ones, summed by task."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        touched = np.zeros(parts * entries, bool)
        for batch in batches:
            v = _matrix(batch.column("v"), parts * width).reshape(-1, parts, width).astype(np.int64)
            old, now = (_matrix(batch.column(n), parts) for n in ("old", "own"))
            for p in range(parts):
                rows = np.flatnonzero(old[:, p] != now[:, p])
                for at, sign in ((old[rows, p], -1), (now[rows, p], 1)):
                    use = at >= 0
                    where = p * entries + at[use]
                    np.add.at(total, where, sign * v[rows[use], p])
                    np.add.at(count, where, sign)
                    touched[where] = True
        at = np.flatnonzero(touched)
        totals = pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array((at // entries).astype(np.int32)), pa.array((at % entries).astype(np.int32)), pa.array(count[at]), totals], ["part", "entry", "n", "total"])

    changed = moved.where(~F.col("old").eqNullSafe(F.col("own")))
    return changed.select("v", "old", "own").mapInArrow(run, "part int, entry int, n long, total array<long>")


def _running(sums: DataFrame | None, deltas: DataFrame, width: int) -> DataFrame:
    """The running sums after the deltas: at most a row per part and entry."""
    both = deltas if sums is None else sums.unionByName(deltas)
    added = [F.sum(F.col("total")[i]).alias(f"_{i}") for i in range(width)]
    return both.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).select("part", "entry", "n", F.array(*[f"_{i}" for i in range(width)]).alias("total"))


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The state (vec_id, label, v, own: the last round's assignments) and the codebooks (parts, entries, width).

    The first codebooks are the parts of the rows of smallest key; there are fewer entries where there are fewer rows.
    Books and running sums have parts times entries rows at most, whatever the table's size.
    """
    state = materialize(integers(vectors, parts, key, vector, label, scale), "parts")
    order = [F.col("vec_id").asc_nulls_last(), F.size("v"), F.col("v")]
    first = [np.array(r.v, np.int64) for r in state.orderBy(*order).limit(entries).select("v").collect()]
    size = len(first[0]) if first else parts
    if any(len(x) != size for x in first) or state.where(F.size("v") != size).take(1):
        mixed, state = state, materialize(state.where(F.size("v") == size), "parts")
        drop_tables(mixed)
        first = [np.array(r.v, np.int64) for r in state.orderBy(*order).limit(entries).select("v").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy()
    sums = None
    for _ in range(rounds if first else 0):
        moved = materialize(_assign(state, books), "assigned")
        before, sums = sums, materialize(_running(sums, _deltas(moved, books.shape), books.shape[2]), "sums")
        for r in sums.where("n > 0").collect():
            books[r.part, r.entry] = np.array(r.total, np.int64) // r.n
        drop_tables(state, before)  # both are superseded by tables that are complete
        state = moved
    return state, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over the parts) by given codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, now, far in _batches(batches, books):
            codes = pa.array([bytes(x).hex() for x in now.astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kind = state.schema["label"].dataType.simpleString()
    return state.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Adds `decoded`, the vector that a code stands for: the middles of its integer cells, divided by scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], np.int64).reshape(-1, len(books))
            out = (np.concatenate([books[p][at[:, p]] for p in range(len(books))], axis=1) + 0.5) / scale
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "decoded"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, decoded array<double>")


def _with_group_sum(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over rows of an equal group, nulls together; rows of hot groups don't move."""
    totals = materialize(rows.groupBy(F.col(group).alias("_g")).agg(F.sum(value).alias(name), F.count("*").alias("_n")), "totals")
    limit = -(-max(1, totals.agg(F.sum("_n")).first()[0] or 1) // HOT)
    hot, cold = (F.broadcast(totals.where(F.col("_n") > limit)), totals.where(F.col("_n") <= limit))
    same: Column = F.col(group).eqNullSafe(F.col("_g"))
    keep = [*rows.columns, name]
    met = rows.join(hot, same).select(keep)
    rest = rows.join(hot.select("_g"), same, "left_anti")
    return met.unionByName(rest.join(cold, same).select(keep))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that takes part.

    A row takes part if its vector isn't null, holds no null or non-finite component, and can be cut: its length is a
    positive multiple of `parts`, and that of the row of smallest key (of equal keys the shorter). A component x becomes
    floor(scale * x), held within 2^26 either way. A null key comes last; rows that repeat a key are all coded, in the
    order of their vectors. Fewer rows than entries give as many entries; an empty table gives no rows. Null labels are one
    group. Other columns are ignored, whatever their names. Two tables of integers exist at a time.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code's index has two hex digits: 1 to 256 entries")
    state, books = codebooks(vectors, parts, entries, rounds, key, vector, label, scale)
    empty = state.selectExpr("vec_id", "label", "'' AS code", "0L AS error")
    coded = materialize(encode(state, books) if books.size else empty, "coded")
    drop_tables(state)
    summed = _with_group_sum(coded, "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
