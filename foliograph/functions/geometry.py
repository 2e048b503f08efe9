"""Affine maps and convex polygons as column expressions: STRUCT<a,b,c,d,e,f> and ARRAY<STRUCT<x,y>> of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.functions.clip import clipped

Number = Column | float


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def matrix(a: Number, b: Number, c: Number, d: Number, e: Number, f: Number) -> Column:
    """x' = a*x + c*y + e, y' = b*x + d*y + f."""
    return F.struct(*[_c(v).cast("double").alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


IDENTITY = (1, 0, 0, 1, 0, 0)


def _compose(m: Column, n: Column) -> Column:
    return matrix(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"],
        m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"],
        m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
    )


def compose(m: Column, n: Column) -> Column:
    """m after n: n is applied first."""
    return let(F.struct(m.alias("m"), n.alias("n")), lambda v: _compose(v["m"], v["n"]))


def translation(x: Number, y: Number) -> Column:
    return matrix(1, 0, 0, 1, x, y)


def scaling(x: Number, y: Number) -> Column:
    return matrix(x, 0, 0, y, 0, 0)


def shape_matrix(x: Column, y: Column, w: Column, h: Column, degrees: Column, flip_h: Column, flip_v: Column) -> Column:
    """Flip and rotate (clockwise) about the middle of w by h, then move to x, y; in closed form. Right angles are exact."""
    turns = F.pmod((degrees / 90).cast("long"), F.lit(4)).cast("int")
    exact = lambda values: F.get(F.array(*[F.lit(v) for v in values]), turns)
    right = degrees % 90 == 0
    parts = F.struct(
        F.when(right, exact((1.0, 0.0, -1.0, 0.0))).otherwise(F.cos(F.radians(degrees))).alias("cos"),
        F.when(right, exact((0.0, 1.0, 0.0, -1.0))).otherwise(F.sin(F.radians(degrees))).alias("sin"),
        F.when(flip_h, -1.0).otherwise(1.0).alias("sx"), F.when(flip_v, -1.0).otherwise(1.0).alias("sy"), (w / 2).alias("cx"), (h / 2).alias("cy"), x.alias("x"), y.alias("y"),
    )

    def built(v: Column) -> Column:
        a, b, c, d = v["cos"] * v["sx"], v["sin"] * v["sx"], -v["sin"] * v["sy"], v["cos"] * v["sy"]
        return matrix(a, b, c, d, v["x"] + v["cx"] - a * v["cx"] - c * v["cy"], v["y"] + v["cy"] - b * v["cx"] - d * v["cy"])

    return let(parts, built)


def folded_matrix(matrices: Column) -> Column:
    """The composition of an array of matrices, the last applied first."""
    return F.aggregate(matrices, matrix(*IDENTITY), _compose)


def point(x: Number, y: Number) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def rectangle(x: Number, y: Number, w: Number, h: Number) -> Column:
    x, y, w, h = map(_c, (x, y, w, h))
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def moved(polygon: Column, m: Column) -> Column:
    both = F.struct(polygon.alias("p"), m.alias("m"))
    return let(both, lambda v: F.transform(v["p"], lambda p: point(v["m"]["a"] * p["x"] + v["m"]["c"] * p["y"] + v["m"]["e"], v["m"]["b"] * p["x"] + v["m"]["d"] * p["y"] + v["m"]["f"])))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounds(polygon: Column) -> Column:
    """STRUCT<x,y,width,height>; null for an empty polygon."""

    def box(corners: Column) -> Column:
        x, y = F.array_min(corners["x"]), F.array_min(corners["y"])
        return F.when(F.size(corners["x"]) > 0, F.struct(x.alias("x"), y.alias("y"), (F.array_max(corners["x"]) - x).alias("width"), (F.array_max(corners["y"]) - y).alias("height")))

    return let(F.struct(F.transform(polygon, lambda p: p["x"]).alias("x"), F.transform(polygon, lambda p: p["y"]).alias("y")), box)


def _after(polygon: Column, i: Column) -> Column:
    """The point after the i-th of a ring."""
    return F.get(polygon, (i + 1) % F.size(polygon))


def signed_area(polygon: Column) -> Column:
    def total(ring: Column) -> Column:
        cross = F.transform(ring, lambda p, i: p["x"] * _after(ring, i)["y"] - _after(ring, i)["x"] * p["y"])
        return F.when(F.size(ring) >= 3, F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / 2).otherwise(F.lit(0.0))

    return let(polygon, total)


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def intersection(subject: Column, clip: Column) -> Column:
    """STRUCT<polygon, area> of the intersection of two convex polygons, empty where its area is at most EPSILON; see functions/clip.py."""
    return clipped(subject, clip)


def boxes_share(a: Column, b: Column) -> Column:
    """The area that two bounds share."""
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
