import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.functions import canonical, geometry, paths, text
from foliograph.plans import config
from foliograph.sources import xml_facts, zip_entries
from foliograph.sources.fixtures import package, zipped
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def many(spark, values, f):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.select(f(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_paths(spark):
    assert many(spark, ["a/./b", "a\\..\\b", "../a", "/a", "C:/a", "", "a/..", "a//b/", "x/../../y"], paths.input_key) == ["a/b", "b", None, None, None, None, None, "a/b", None]
    assert many(spark, ["ÀA/b:C%", "a\\b"], paths.encoded_key) == ["ÀA/b%3AC%25", "a%5Cb"]
    assert many(spark, ["ÀBc"], paths.part_key) == ["Àbc"]
    assert many(spark, ["_rels/.rels", "a/_rels/b.xml.rels", "_rels/c.rels"], paths.source_of_rels) == [None, "a/b.xml", "c"]
    assert many(spark, [None, "a/b.xml", "c"], paths.rels_of_source) == ["_rels/.rels", "a/_rels/b.xml.rels", "_rels/c.rels"]
    assert many(spark, ["../m/i.png", "/m/i.png", "../../../x", "http://x", "a#b", "a?b", "", "i.png"], lambda t: paths.resolved_target(F.lit("a/b/c.xml"), t)) == ["a/m/i.png", "m/i.png", None, None, None, None, None, "a/b/i.png"]
    assert many(spark, ["application/xml", " TEXT/XML ; charset=x", "image/svg+xml", "image/png", None], paths.is_xml_type) == [True, True, True, False, False]


@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), min_size=1, max_size=7).map("/".join), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_folding_is_normpath(spark, values):
    for value, got in zip(values, many(spark, values, paths.folded), strict=True):
        want = posixpath.normpath("r/" + value.lstrip("/")).removeprefix("r").lstrip("/") if value else ""
        climbs = any(posixpath.normpath("/".join(value.strip("/").split("/")[:n]) or ".").startswith("..") for n in range(1, 9))
        assert got == (None if climbs or not want else want)


def test_numbers(spark):
    for x, digits, want in ((-2.5, 0, -2.0), (2.5, 0, 3.0), (0.0005, 3, 0.001), (-0.0001, 3, 0.0), (1e300, 3, 1e300)):
        assert one(spark, canonical.round_half_up(F.lit(x), digits)) == want
    assert [one(spark, canonical.number_text(F.lit(x))) for x in (12.0, 79.37, 442800000000.0)] == ["12", "79.37", "442800000000"]
    assert one(spark, canonical.trim_all(F.lit("\u00a0\ufeff a b\u2003\n"))) == "a b"
    assert one(spark, canonical.at_least(F.lit(0.1 + 0.1 + 0.1 - 2**-53), 0.3))
    assert one(spark, canonical.json_object(b=canonical.json_text(F.lit('q"\n')), a=canonical.json_list(F.array(canonical.json_number(F.lit(1.0)))))) == '{"a":[1],"b":"q\\"\\n"}'


def test_geometry(spark):
    turned = geometry.moved(geometry.rectangle(0, 0, 4, 2), geometry.shape_matrix(*[F.lit(float(v)) for v in (10, 10, 4, 2, 90)], F.lit(True), F.lit(False)))
    assert one(spark, geometry.bounds(turned)).asDict() == {"x": 11.0, "y": 9.0, "width": 2.0, "height": 4.0}
    square = geometry.rectangle(0, 0, 2, 2)
    diamond = F.array(*[geometry.point(x, y) for x, y in ((1, -1), (3, 1), (1, 3), (-1, 1))])
    assert one(spark, geometry.intersection(square, diamond)["area"]) == pytest.approx(4)
    assert one(spark, geometry.area(geometry.intersection(square, F.reverse(geometry.rectangle(1, 1, 5, 5)))["polygon"])) == pytest.approx(1)
    assert one(spark, F.size(geometry.intersection(square, geometry.rectangle(2, 0, 1, 1))["polygon"])) == 0


@given(st.lists(st.tuples(*[st.integers(-20, 20)] * 2, *[st.integers(1, 20)] * 2, *[st.integers(-20, 20)] * 2, *[st.integers(1, 20)] * 2), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_clip_of_rectangles(spark, rows):
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, x double, y double, w double, h double, u double, v double, a double, b double")
    got = frame.select("i", geometry.intersection(geometry.rectangle(*[F.col(c) for c in "xywh"]), geometry.rectangle(*[F.col(c) for c in "uvab"]))["area"].alias("s")).orderBy("i").collect()
    for (x, y, w, h, u, v, a, b), r in zip(rows, got, strict=True):
        assert r.s == pytest.approx(max(0, min(x + w, u + a) - max(x, u)) * max(0, min(y + h, v + b) - max(y, v)))


def test_scripts(spark):
    assert many(spark, ["abc", "漢", "שלום a", "123", "漢1", "", "กขค", "ひ漢 ab"], text.script_slots) == [["latin"], ["eastAsian"], ["latin", "complexScript"], ["latin"], ["eastAsian"], ["latin"], ["complexScript"], ["latin", "eastAsian"]]
    scripts = lambda t, lang: one(spark, text.theme_scripts(F.lit(t), F.lit("eastAsian"), F.lit(lang).cast("string")))
    assert scripts("漢", None) == ["Hans", "Hant"] and scripts("漢", "zh-TW") == ["Hant"] and scripts("漢ひ", "zh-TW") == ["Jpan"] and scripts("한", None) == ["Hang"]


def test_config():
    assert set(config.resolve().enabled()) == {k for k, (s, _) in config.RULES.items() if s != "off"} and not config.resolve({}).enabled()
    assert config.resolve({"failOn": "warning"}, "error").fail_on == "error"
    assert config.digest(config.resolve()) == "fc9f57e76658b4c848f6b36e02ec638b50b478f86e127aebdcb6ba6b269c8eb2"
    for bad in ({"x": 1}, {"rules": {"no/rule": "error"}}, {"rules": {"fonts/allowed": "error"}}, {"rules": {"layout/text-overlap": ["error", {"minOverlapRatio": 2}]}}, {"ignore": [{"rule": "text/min-font-size"}]}, {"failOn": "off"}, {"rules": {"fonts/allowed": ["error", {"families": ["A", "a "]}]}}):
        with pytest.raises(config.ConfigError):
            config.resolve(bad)


def test_zip():
    body = zipped([("a", b"x" * 500), ("a", b"y"), ("", b"")], deflate=True)
    found = zip_entries.entries(body)
    assert [e.name for e in found] == ["a", "a", ""] and zip_entries.read(body, found[0]) == (b"x" * 500, None)
    forged = zipped([("a", b"x" * 500)], deflate=True, size=10)
    assert zip_entries.read(forged, zip_entries.entries(forged)[0])[1] == "actual-size-limit-exceeded"
    longer = zipped([("a", b"x" * 500)], deflate=True, size=900)
    assert zip_entries.read(longer, zip_entries.entries(longer)[0])[1] == "entry-size-mismatch"
    for bad in (b"", b"PK\x05\x06", body[:-1], body + b"z", zipped([("a", b"")], count=2)):
        with pytest.raises(zip_entries.ZipError):
            zip_entries.entries(bad)


def test_xml_codes():
    for data, code in ((b"<a>", "malformed-xml"), (b"<q:a/>", "invalid-namespace"), (b"<!DOCTYPE a><a/>", "dtd-prohibited"), (b"\xff<a/>", "unsupported-encoding"), (b"<a b='1' b='2'/>", "malformed-xml"), (b"<a:b:c/>", "invalid-namespace")):
        with pytest.raises(xml_facts.Bad) as e:
            xml_facts.parse(data)
        assert e.value.code == code
    assert xml_facts.parse(b"<a><![CDATA[<!DOCTYPE]]></a>").tag == "a" and xml_facts.parse('<?xml version="1.0" encoding="utf-16"?><a/>'.encode("utf-16")).tag == "a"
    assert package()


def test_overlapping_entries():
    body = zipped([("a", "x" * 50), ("b", "y" * 50), ("c", "z")])
    found = zip_entries.entries(body)
    assert zip_entries.overlapping(found) == set()
    second = found[1].__class__(**{f: getattr(found[1], f) for f in found[1].__dataclass_fields__} | {"offset": found[0].offset + 10})
    assert zip_entries.overlapping([found[0], second, found[2]]) == {0, 1}


def test_faults_of_names(spark):
    raw = ["", "a\\b", "/a", "C:x", "../a", "a/../../b", "./", "a/..", "x\0y", "ok/./a"]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(paths.name_fault(F.col("r")).alias("f"), paths.part_name(F.col("r")).alias("n")).collect()
    assert [r.f for r in got] == ["empty-part-name", "backslash-in-part-name", "absolute-part-name", "absolute-part-name", "path-traversal", "path-traversal", "empty-part-name", "empty-part-name", "invalid-part-name", None]
    assert [r.f is None for r in got] == [r.n is not None for r in got]
