"""Pairs of boxes by a grid, clips of whole batches, positions of XML faults and the order of text."""

import functools
import operator
import random

import pyarrow as pa
import pytest

from foliograph.functions import canonical, clip, geometry
from foliograph.operators import relational
from foliograph.sources import xml_facts
from pyspark.sql import functions as F


def boxes(spark, rows):
    schema = "g int, id int, bounds struct<x:double,y:double,width:double,height:double>"
    return relational.with_grid(spark.createDataFrame([(g, i, (float(x), float(y), float(w), float(h))) for g, i, x, y, w, h in rows], schema), ["g"], "bounds")


def overlapping(rows):
    out = set()
    for g, i, x, y, w, h in rows:
        out |= {(g, i, j) for k, j, u, v, s, t in rows if k == g and i < j and x < u + s and u < x + w and y < v + t and v < y + h}
    return out


@pytest.mark.parametrize("kind", ["even", "mixed", "same", "few"])
def test_pairs_of_the_grid(spark, kind):
    rng = random.Random(kind)
    size = {"even": lambda: 30, "mixed": lambda: rng.choice((5, 20, 900)), "same": lambda: 50, "few": lambda: 300}[kind]
    rows = [(g, i, *((7, 7) if kind == "same" else (rng.randint(-50, 950), rng.randint(0, 900))), size(), size()) for g in range(2) for i in range(9 if kind == "few" else 150)]
    found = relational.meeting(boxes(spark, rows), boxes(spark, rows), ["g"], F.col("a_id") < F.col("b_id")).select("g", "a_id", "b_id").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == overlapping(rows)


def test_a_slide_of_ten_thousand_shapes_tests_few_pairs(spark):
    rows = [(1, i, i % 100 * 100, i // 100 * 100, 110, 110) for i in range(10_000)]
    grid = boxes(spark, rows)
    b, g = F.col("bounds"), F.col("grid")
    met = relational.meeting(grid, grid, ["g"], F.col("a_id") < F.col("b_id")).count()
    cells = grid.select(F.explode(F.sequence(relational._cell(b["x"], g["x"], g["cell_w"], g["across"]), relational._cell(b["x"] + b["width"], g["x"], g["cell_w"], g["across"]))).alias("i"), F.sequence(relational._cell(b["y"], g["y"], g["cell_h"], g["down"]), relational._cell(b["y"] + b["height"], g["y"], g["cell_h"], g["down"])).alias("js")).select("i", F.explode("js").alias("j"))
    tested = cells.groupBy("i", "j").count().select(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert met == 2 * 99 * 100 + 2 * 99 * 99 and tested < 20 * met


def hull(points):
    points = sorted(set(points))
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out = []
    for half in (points, points[::-1]):
        side = []
        for p in half:
            while len(side) > 1 and cross(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        out += side[:-1]
    return out


def plain_clip(subject, by):
    """One polygon at a time, with plain lists."""
    area = lambda r: functools.reduce(operator.add, (p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True)), 0.0) / 2 if len(r) > 2 else 0.0
    by = by[::-1] if area(by) < 0 else by
    for a, b in zip(by, by[1:] + by[:1], strict=True):
        side = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
            s, t = side(p), side(q)
            if (s >= -1e-9) != (t >= -1e-9):
                k = s / (s - t) if abs(s - t) > 1e-9 else 0.0
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
            if t >= -1e-9:
                out.append(q)
        subject = out
    near = lambda p, q: abs(p[0] - q[0]) <= 1e-9 and abs(p[1] - q[1]) <= 1e-9
    kept = [p for i, p in enumerate(subject) if len(subject) == 1 or not near(p, subject[(i + 1) % len(subject)])]
    return (kept, abs(area(kept))) if abs(area(kept)) > 1e-9 else ([], 0.0)


def test_clips_of_batches_are_those_of_single_polygons():
    rng = random.Random(5)
    shape = lambda: hull([(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(rng.randint(3, 9))])
    box = lambda: [(x, y) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))]
    pairs = [(shape(), shape()[:: rng.choice((1, -1))]) for _ in range(300)] + [(box(), shape()) for _ in range(50)] + [(box(), box()), ([], box()), (box(), [(20, 20), (21, 20), (21, 21)]), (box(), box()[::-1])]
    kind = pa.list_(clip.POINT)
    columns = [pa.array([[{"x": float(x), "y": float(y)} for x, y in p[i]] for p in pairs], kind) for i in (0, 1)]
    rings, area = clip.clip(clip.Rings.of(columns[0]), clip.Rings.of(columns[1]))
    for i, (subject, by) in enumerate(pairs):
        want, size = plain_clip([(float(x), float(y)) for x, y in subject], [(float(x), float(y)) for x, y in by])
        assert [tuple(p) for p in zip(rings.x[i, : rings.n[i]], rings.y[i, : rings.n[i]], strict=True)] == want and area[i] == size


def test_clip_column_and_nulls(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (None, None)], "x double, y double")
    polygon = F.when(F.col("x").isNotNull(), geometry.rectangle(F.col("x"), F.col("y"), 4, 4))
    got = rows.select(geometry.intersection(polygon, geometry.rectangle(2, 2, 10, 10)).alias("c")).collect()
    assert [None if r.c is None else (r.c.area, len(r.c.polygon)) for r in got] == [(4.0, 4), (16.0, 4), None]


def test_outside_by_product_and_by_clip(spark):
    """Unrotated boxes, and squares on a corner, of which the frame cuts a half, a quarter or nothing."""
    turned = lambda x, y, r: [(x - r, y), (x, y - r), (x + r, y), (x, y + r)]
    flat = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rows = [("half", flat(8, 0, 4, 2)), ("in", flat(1, 1, 2, 2)), ("quarter", turned(10, 10, 2)), ("edge", turned(10, 5, 2)), ("little", flat(9.9, 0, 2, 2))]
    frame = spark.createDataFrame([(n, [(float(a), float(b)) for a, b in p], (0.0, 0.0, 10.0, 10.0)) for n, p in rows], "n string, polygon array<struct<x:double,y:double>>, frame struct<x:double,y:double,width:double,height:double>")
    got = {r.n: round(r.outside_ratio, 6) for r in relational.outside(frame, "polygon", "frame", 0.5, 0.1).collect()}
    assert got == {"half": 0.5, "quarter": 0.75, "edge": 0.5, "little": 0.95}


@pytest.mark.parametrize(
    ("xml", "code", "place"),
    [
        ("<a><b></a>", "malformed-xml", (1, 7, 6)), ('<p:s xmlns:p="urn:p"><p:c></p:s>', "malformed-xml", (1, 27, 26)), ("<r>\n  \U0001d4b3é<b>\n</r>", "malformed-xml", (3, 1, 13)), ("<r/>x", "malformed-xml", (1, 5, 4)),
        ("<root><future:item/></root>", "invalid-namespace", (None, None, None)), ('<a:1 xmlns:a="urn:a"/>', "invalid-namespace", (None, None, None)), ('<root xmlns:a="urn:a" a:1="x"/>', "invalid-namespace", (None, None, None)),
        ('<root xmlns:a:b="urn:x"/>', "invalid-namespace", (None, None, None)), ('<r xmlns:p=""/>', "invalid-namespace", (None, None, None)), ('<r xmlns:a="u" xmlns:b="u" a:x="" b:x=""/>', "invalid-namespace", (None, None, None)),
        ("<!-- <!DOCTYPE x> -->\n\U0001d4b3<!DOCTYPE x><x/>", "dtd-prohibited", (2, 3, 24)), ('<?xml version="1.0" encoding="UTF-16"?><root/>', "unsupported-encoding", (None, None, None)),
        ('<?xml version="1.0" encoding="windows-1252"?><root/>', "unsupported-encoding", (None, None, None)), ('<?xml version="1.0" encoding="UTF-8"?><root><x></root>', "malformed-xml", (1, 48, 47)),
    ],
)
def test_positions_of_faults(xml, code, place):
    with pytest.raises(xml_facts.Bad) as e:
        xml_facts.parse(xml.encode())
    assert (e.value.code, (e.value.line, e.value.column, e.value.offset)) == (code, place)


def test_encodings():
    wide = '<?xml version="1.0" encoding="UTF-16"?><é:r xmlns:é="urn:é" é:a="1">ok</é:r>'
    assert xml_facts.parse(wide.encode("utf-16")).text == "ok" and xml_facts.parse(b"\xef\xbb\xbf<r>x</r>").text == "x"
    with pytest.raises(xml_facts.Bad) as e:
        xml_facts.parse('<?xml version="1.0" encoding="UTF-8"?><root/>'.encode("utf-16"))
    assert e.value.code == "unsupported-encoding"


def test_text_sorts_by_code_units(spark):
    names = ["\U0001f600", "～", "z", "é", "", "a"]
    got = spark.createDataFrame([(names,)], "n array<string>").select(canonical.sorted_text(F.col("n")).alias("n")).first().n
    assert got == sorted(names, key=lambda s: s.encode("utf-16-be")) and got.index("\U0001f600") < got.index("")


def test_first_and_last_without_sorting_aggregates(spark):
    rows = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (None, 2, "x"), (None, 2, "y"), (2, 5, "z")], "k int, o int, v string")
    first = relational.first_wins(rows, ["k"], ["o", "v"])
    assert {tuple(r) for r in first.collect()} == {(1, 1, "a", 1), (None, 2, "x", 1), (2, 5, "z", 0)}
    last = relational.last_value_first_place(rows.where("k IS NOT NULL"), ["k"], "o")
    assert {tuple(r) for r in last.collect()} == {(1, 1, "c"), (2, 5, "z")}
    for df in (first, last):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
