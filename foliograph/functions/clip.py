"""Clipping of convex polygons by convex polygons, over whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances and areas up to this are none (fixed value).
EPSILON = 1e-9
CLIPPED = "STRUCT<polygon: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, area: DOUBLE>"
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


class Rings:
    """Polygons of a batch as rows of one width: corners x, y, of which the first n of a row count."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        self.x, self.y, self.n = x, y, n

    @staticmethod
    def of(lists: pa.ListArray) -> Rings:
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        corners, width = lists.flatten(), max(1, int(n.max(initial=0)))
        at = (np.cumsum(n) - n)[:, None] + np.minimum(np.arange(width), np.maximum(n - 1, 0)[:, None])
        at = np.minimum(at, max(0, len(corners) - 1))
        x, y = (corners.field(i).to_numpy(zero_copy_only=False) if len(corners) else np.zeros(1) for i in (0, 1))
        return Rings(x[at], y[at], n)

    def next(self, values: np.ndarray) -> np.ndarray:
        """The values of the corners that follow."""
        at = np.arange(self.x.shape[1])[None, :] + 1
        return np.take_along_axis(values, np.where(at < self.n[:, None], at, 0), axis=1)

    def counts(self) -> np.ndarray:
        return np.arange(self.x.shape[1])[None, :] < self.n[:, None]

    def signed_area(self) -> np.ndarray:
        cross = np.where(self.counts(), self.x * self.next(self.y) - self.next(self.x) * self.y, 0.0)
        total = np.zeros(len(self.n))
        for i in range(cross.shape[1]):  # in the corners' order
            total += cross[:, i]
        return np.where(self.n >= 3, total / 2, 0.0)

    def chosen(self, keep: np.ndarray, x: np.ndarray, y: np.ndarray) -> Rings:
        """Rings of the kept points of each row, in their order."""
        n = keep.sum(axis=1)
        row, column = np.nonzero(keep)
        at = (np.cumsum(keep, axis=1) - 1)[row, column]
        out = np.zeros((2, len(n), max(1, int(n.max(initial=0)))))
        out[0, row, at], out[1, row, at] = x[row, column], y[row, column]
        return Rings(out[0], out[1], n)

    def turned(self) -> Rings:
        """The rings, those that run clockwise reversed."""
        at = np.arange(self.x.shape[1])[None, :]
        at = np.where((self.signed_area() < 0)[:, None], np.maximum(self.n[:, None] - 1 - at, 0), at)
        return Rings(np.take_along_axis(self.x, at, axis=1), np.take_along_axis(self.y, at, axis=1), self.n)

    def cut(self, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, where: np.ndarray) -> Rings:
        """What is left of each row's line from a to b, or on it; rows that `where` excludes stay as they are."""
        side = (bx - ax)[:, None] * (self.y - ay[:, None]) - (by - ay)[:, None] * (self.x - ax[:, None])
        other, to_x, to_y = self.next(side), self.next(self.x), self.next(self.y)
        gap = side - other
        share = np.where(np.abs(gap) > EPSILON, side / np.where(gap == 0, 1.0, gap), 0.0)
        here, there = side >= -EPSILON, other >= -EPSILON
        whole = ~where[:, None]
        # a crossing where one end is inside, then the end if it is; whole rings keep their corners in their order
        points = np.stack((np.where(whole, self.x, self.x + share * (to_x - self.x)), to_x), axis=2), np.stack((np.where(whole, self.y, self.y + share * (to_y - self.y)), to_y), axis=2)
        keep = np.stack((whole | (here != there), ~whole & there), axis=2) & self.counts()[:, :, None]
        flat = (len(self.n), -1)
        return self.chosen(keep.reshape(flat), points[0].reshape(flat), points[1].reshape(flat))

    def apart(self) -> Rings:
        """Without corners that the next one repeats."""
        near = (np.abs(self.x - self.next(self.x)) <= EPSILON) & (np.abs(self.y - self.next(self.y)) <= EPSILON)
        return self.chosen(self.counts() & (~near | (self.n == 1)[:, None]), self.x, self.y)


def clip(subject: Rings, by: Rings) -> tuple[Rings, np.ndarray]:
    """Intersections and their areas; empty where the area is at most EPSILON."""
    by = by.turned()
    to_x, to_y = by.next(by.x), by.next(by.y)
    for e in range(by.x.shape[1]):
        subject = subject.cut(by.x[:, e], by.y[:, e], to_x[:, e], to_y[:, e], e < by.n)
    out = subject.apart()
    area = np.abs(out.signed_area())
    out.n = np.where(area > EPSILON, out.n, 0)
    return out, np.where(area > EPSILON, area, 0.0)


def _lists(rings: Rings) -> pa.ListArray:
    held = rings.counts()
    offsets = np.concatenate(([0], np.cumsum(rings.n))).astype(np.int32)
    corners = pa.StructArray.from_arrays([pa.array(rings.x[held]), pa.array(rings.y[held])], fields=list(POINT))
    return pa.ListArray.from_arrays(pa.array(offsets), corners)


def _clipped(subject: pa.Array, by: pa.Array) -> pa.Array:
    none = np.asarray(subject.is_null()) | np.asarray(by.is_null())
    rings, area = clip(Rings.of(subject), Rings.of(by))
    return pa.StructArray.from_arrays([_lists(rings), pa.array(area)], names=["polygon", "area"], mask=pa.array(none))


def clipped(subject: Column, by: Column) -> Column:
    """STRUCT<polygon, area>: the part of a convex polygon in another; null if either is. Worked out once for a row, however often a plan names it."""
    return F.arrow_udf(_clipped, CLIPPED).asNondeterministic()(subject, by)
