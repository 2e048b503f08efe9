"""Many packages in one job, each built for a rule or a boundary; and the golden package."""

import struct
import zlib

import pytest

from foliograph.plans import config, inspection
from foliograph.sources import decks, fixtures
from foliograph.sources.fixtures import package, rels, text_shape, tree, xfrm, zipped

FULL = (0, 0, 3000000, 1000000)
SOLID = '<a:solidFill><a:srgbClr val="112233"/></a:solidFill>'
PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)), (b"IEND", b"")))
PICTURE = f'<p:pic><p:nvPicPr><p:cNvPr id="9" name="Picture"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rId7"/></p:blipFill><p:spPr>{xfrm(*FULL)}<a:prstGeom prst="rect"/></p:spPr></p:pic>'


def cell(text, more=""):
    return f"<a:tc{more}><a:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></a:txBody></a:tc>"


TABLE = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="5" name="Table"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="0" y="0"/><a:ext cx="4000000" cy="2000000"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tblGrid><a:gridCol w="100"/><a:gridCol w="300"/></a:tblGrid><a:tr h="50">{cell("wide", " gridSpan=" + chr(34) + "2" + chr(34))}{cell("", " hMerge=" + chr(34) + "1" + chr(34))}</a:tr><a:tr h="50">{cell("left")}{cell("right")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
GROUP = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="20" name="G"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="1000000" y="1000000"/><a:ext cx="2000000" cy="2000000"/><a:chOff x="0" y="0"/><a:chExt cx="1000000" cy="1000000"/></a:xfrm></p:grpSpPr>{text_shape(21, "In", (0, 0, 500000, 500000))}</p:grpSp>'
TITLE = '<p:ph type="title" idx="0"/>'
OUTSIDE = text_shape(4, "Out", (12000000, 0, 384000, 100000))  # half of it is over the edge

DECKS = {
    "golden": fixtures.golden(),
    "clean": zipped(package(text_shape(2, "A", FULL)), deflate=True),
    "outside": zipped(package(OUTSIDE)),
    "tolerated": zipped(package(text_shape(4, "In reach", (12192000 - 1000000 + 25400, 0, 1000000, 100000)))),
    "hidden": zipped(package(text_shape(4, "Hidden", (12000000, 0, 384000, 100000), run='<a:rPr sz="500"/>', marks=' hidden="1"'))),
    "overlap": zipped(package(text_shape(3, "B", FULL) + text_shape(2, "A", (1500000, 0, 3000000, 1000000)))),
    "equal-ids": zipped(package(text_shape(2, "A", FULL) + text_shape(2, "B", FULL))),
    "rotated": zipped(package(text_shape(2, "A", (2000000, 0, 1000000, 4000000), more=' rot="5400000"') + text_shape(3, "B", (600000, 1600000, 400000, 400000)))),
    "table": zipped(package(TABLE + text_shape(6, "Over a cell", (2000000, 1000000, 2000000, 1000000)))),
    "group": zipped(package(GROUP + text_shape(30, "Same place", (1000000, 1000000, 1000000, 1000000)))),
    "covered": zipped(package(text_shape(2, "Text", FULL) + text_shape(3, "Cover", FULL, text="", fill=SOLID))),
    "under": zipped(package(text_shape(3, "Cover", FULL, text="", fill=SOLID) + text_shape(2, "Text", FULL))),
    "clear": zipped(package(text_shape(2, "Text", FULL) + text_shape(3, "Cover", FULL, text="", fill=SOLID.replace("/></a:solid", '><a:alpha val="50000"/></a:srgbClr></a:solid')))),
    "scheme": zipped(package(text_shape(2, "Text", FULL) + text_shape(3, "Cover", FULL, text="", fill='<a:solidFill><a:schemeClr val="bg1"/></a:solidFill>'))),
    "picture": zipped(package(text_shape(2, "Text", FULL) + PICTURE, extra=(("ppt/media/i.png", PNG),), slide_rels=(("rId7", "image", "../media/i.png"),))),
    "media": zipped(package(slide_rels=(("rId8", "video", "../media/gone.mp4"), ("rId9", "image", "!http://x/y.png")))),
    "broken": zipped(package(slide_rels=(("rId8", "chart", "../charts/chart9.xml"),))),
    "climbing": zipped(package(slide_rels=(("rId8", "chart", "../../../../up.xml"),))),
    "malformed": zipped(package(extra=(("ppt/notes.xml", "<a><b></a>"),))),
    "dtd": zipped(package(extra=(("ppt/notes.xml", "<!-- <!DOCTYPE x> -->\n<!DOCTYPE x><x/>"),))),
    "prefix": zipped(package(extra=(("ppt/notes.xml", "<q:x/>"),))),
    "latin1": zipped(package(extra=(("ppt/notes.xml", '<?xml version="1.0" encoding="ISO-8859-1"?><x/>'),))),
    "utf16": zipped(package(extra=(("ppt/notes.xml", '<?xml version="1.0" encoding="UTF-16"?><x/>'.encode("utf-16")),))),
    "twice": zipped(package(extra=(("PPT/Theme/theme1.xml", "<x/>"),))),
    "autofit": zipped(package(text_shape(2, "A", FULL, autofit="<a:normAutofit/>"))),
    "scaled": zipped(package(text_shape(2, "A", FULL, run='<a:rPr sz="1000"/>', autofit='<a:normAutofit fontScale="90%"/>'))),
    "size-invalid": zipped(package(text_shape(2, "A", FULL, run='<a:rPr sz="50"/>'))),
    "title": zipped(package(text_shape(2, "Title", None, ph=TITLE), layout=text_shape(3, "L", (0, 0, 2000000, 500000), text="", ph=TITLE))),
    "no-place": zipped(package(text_shape(2, "Title", None, ph=TITLE))),
    "japanese": zipped(package(text_shape(2, "A", FULL, text="日本語ひら"))),
    "order": zipped(package(slides={"slideB.xml": tree("sld", OUTSIDE), "slideA.xml": tree("sld")})),
    "cut": fixtures.golden()[:-9],
    "count": zipped(package(), count=3),
    "crc": zipped(package(), crc=1),
    "no-office": zipped([("a.xml", "<x/>")]),
    "no-types": zipped(package()[1:]),
    "types-twice": zipped([(n, d.replace("</Types>", '<Default Extension="XML" ContentType="a/b"/></Types>') if n == "[Content_Types].xml" else d) for n, d in package(slide_rels=(("rId8", "image", "../media/gone.png"),))]),
    "types-odd": zipped([(n, d.replace("</Types>", '<Override PartName="/../x" ContentType="a/b"/><Default Extension="" ContentType="a/b"/></Types>') if n == "[Content_Types].xml" else d) for n, d in package()]),
    "types-bad": zipped([(n, "<Types>" if n == "[Content_Types].xml" else d) for n, d in package()]),
    "vml": zipped([(n, d.replace("</Types>", '<Override PartName="/ppt/d.vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/></Types>') if n == "[Content_Types].xml" else d) for n, d in package(extra=(("ppt/d.vml", "<xml>"),))]),
    "default-xml": zipped([(n, d.replace("</Types>", '<Default Extension="vml" ContentType="text/xml; x=y"/></Types>') if n == "[Content_Types].xml" else d) for n, d in package(extra=(("ppt/d.vml", "<xml>"),))]),
    "no-presentation": zipped([e for e in package() if e[0] != "ppt/presentation.xml"]),
    "no-layout": zipped([e for e in package() if not e[0].endswith("slide1.xml.rels")]),
    "no-theme": zipped([e for e in package() if "theme1" not in e[0]]),
    "rels-bad": zipped([(n, "<Relationships>" if n == "ppt/slides/_rels/slide1.xml.rels" else d) for n, d in package()]),
    "root-bad": zipped([(n, "<Relationships>" if n == "_rels/.rels" else d) for n, d in package()]),
    "odd-root": zipped([(n, d.replace("p:sld ", "p:sldX ").replace("p:sld>", "p:sldX>") if n == "ppt/slides/slide1.xml" else d) for n, d in package()]),
    "no-size": zipped([(n, d.replace('cx="12192000"', 'cx="0"') if n == "ppt/presentation.xml" else d) for n, d in package()]),
    "lost-id": zipped([(n, d.replace('r:id="rId2"', 'r:id="rId77"') if n == "ppt/presentation.xml" else d) for n, d in package()]),
    "unreached": zipped([e for e in package() if e[0] != "ppt/slides/slide1.xml"]),
}
ALL = {"extends": ["recommended"], "rules": {"layout/text-occluded": "error", "fonts/allowed": ["warning", {"families": ["arial "], "unresolved": "ignore"}]}}
RULES = {
    "golden": {"layout/outside-slide": 1, "text/autofit-scale-below-minimum": 1, "text/min-font-size": 1}, "outside": {"layout/outside-slide": 1}, "overlap": {"layout/text-overlap": 1},
    "rotated": {"layout/text-overlap": 1}, "table": {"layout/text-overlap": 1}, "group": {"layout/text-overlap": 1}, "covered": {"layout/text-occluded": 1}, "picture": {"layout/text-occluded": 1}, "media": {"package/missing-media": 1},
    "broken": {"package/broken-relationship": 1}, "climbing": {"package/broken-relationship": 1}, "malformed": {"package/malformed-xml": 1}, "dtd": {"package/malformed-xml": 1}, "prefix": {"package/malformed-xml": 1},
    "latin1": {"package/malformed-xml": 1}, "autofit": {"text/autofit-enabled": 1}, "scaled": {"text/autofit-scale-below-minimum": 1}, "title": {"text/min-font-size": 1}, "no-place": {"text/min-font-size": 1}, "japanese": {"fonts/allowed": 1}, "order": {"layout/outside-slide": 1}, "unreached": {"package/broken-relationship": 1},
    "types-twice": {"package/missing-media": 1}, "types-bad": {"package/malformed-xml": 1}, "vml": {"package/malformed-xml": 1}, "default-xml": {"package/malformed-xml": 1}, "no-presentation": {"package/broken-relationship": 1}, "no-theme": {"package/broken-relationship": 1},
    "rels-bad": {"package/malformed-xml": 1}, "root-bad": {"package/malformed-xml": 1}, "equal-ids": {}, "twice": {"package/broken-relationship": 1},
}


@pytest.fixture(scope="module")
def done(spark):
    files = decks.decks(spark.createDataFrame([(f"in/./{k}.pptx", v) for k, v in DECKS.items()] + [("../up.pptx", b"")], "file string, content binary").repartition(4))
    out = inspection.inspect(files, config.resolve(ALL))
    rows = [r.asDict() for r in out["findings"].collect()]
    return {"rows": rows, "summary": {r.input_key: r for r in out["summary"].collect()}, "diagnostics": {(r.input_key, r.code) for r in out["diagnostics"].collect()}}


def of(done, name):
    return [r for r in done["rows"] if r["input_key"] == f"in/{name}.pptx"]


@pytest.mark.parametrize("name", DECKS)
def test_rules(done, name):
    got = {}
    for r in of(done, name):
        got[r["rule_id"]] = got.get(r["rule_id"], 0) + 1
    assert got == RULES.get(name, {})


def test_golden_values(spark):
    """Identities, ratio and sizes of the golden package (fixed values)."""
    files = decks.decks(spark.createDataFrame([("examples/public-broken-deck.pptx", DECKS["golden"])], "file string, content binary"))
    rows = inspection.findings(inspection.facts(files), config.resolve()).collect()
    assert {(r.rule_id, r.fingerprint) for r in rows} == {
        ("layout/outside-slide", "b610fc1ccb18c1159962694e27f28ba93fa8aa0f9a58da6276cd0387afc9e821"),
        ("text/autofit-scale-below-minimum", "4fb8a2226c58cc7fe79e57a94c1bcec9a296cbba0bbec92f57b7813a7c72aa1d"),
        ("text/min-font-size", "c038cd30376efd3f2e6cbda502b94de4b92293f6e91b51bb2c3bb4b2b7ede1ba"),
    }
    evidence = " ".join(r.evidence for r in rows)
    for part in ('"outsideRatio":0.672', '"outsideAreaEmu2":907200000000', '"intersectionAreaEmu2":442800000000', '"effectiveFontSizePt":9.6', '"baseFontSizePt":9', '"x":921.26', '"affectedEdges":["right"]', '"rawFontScale":"40000"'):
        assert part in evidence


def test_places(done):
    assert of(done, "order")[0]["slide_number"] == 1 and of(done, "order")[0]["part"] == "ppt/slides/slideB.xml"
    assert '"outsideRatio":0.5' in of(done, "outside")[0]["evidence"]
    assert of(done, "overlap")[0]["shape_ids"] == [2, 3] and '"overlapRatio":0.5' in of(done, "overlap")[0]["evidence"]
    assert '"secondTextFrame":"shape"' in of(done, "table")[0]["evidence"] and '"firstTextFrame":"table:r1:c1"' in of(done, "table")[0]["evidence"]
    assert '"overlapRatio":1' in of(done, "group")[0]["evidence"]
    assert '"resolvedTypeface":"Yu Gothic"' in of(done, "japanese")[0]["evidence"]
    assert '"line":2' in of(done, "dtd")[0]["evidence"]


def test_exit_codes_and_diagnostics(done):
    code = {k and k[3:-5]: r.exit_code for k, r in done["summary"].items()}
    assert code["clean"] == 0 and code["golden"] == 1 and code["outside"] == 0 and code["malformed"] == 1 and code[None] == 2
    assert all(code[k] == 2 for k in ("cut", "count", "crc", "no-office", "no-place", "twice"))
    assert done["summary"]["in/clean.pptx"].complete and not done["summary"]["in/malformed.pptx"].complete
    assert done["summary"]["../up.pptx"].exit_code == 2
    found = done["diagnostics"]
    for name, c in (("crc", "entry-read-failed"), ("twice", "ambiguous-part-name"), ("no-place", "unsupported-geometry"), ("climbing", "invalid-relationship-target"), ("unreached", "missing-presentation-target"), ("no-office", "missing-office-document")):
        assert (f"in/{name}.pptx", c) in found
    assert done["summary"]["in/no-office.pptx"].skipped > 0


def test_incomplete_packages(done):
    """Code 2 where no finding accounts for what is missing, 1 where one does; never complete."""
    for name, code, *found in (
        ("no-types", 2, "missing-content-types"), ("types-twice", 2, "duplicate-content-type"), ("types-odd", 2, "invalid-content-types"), ("types-bad", 1, "invalid-content-types", "malformed-xml"), ("vml", 1), ("default-xml", 1),
        ("no-presentation", 1, "missing-presentation-part"), ("no-layout", 2, "missing-presentation-relationship"), ("no-theme", 1, "missing-presentation-target"), ("unreached", 1, "missing-presentation-target"),
        ("rels-bad", 1, "invalid-relationships", "malformed-xml", "missing-presentation-relationship"), ("root-bad", 1, "invalid-relationships", "malformed-xml", "missing-office-document"),
        ("odd-root", 2, "invalid-presentation"), ("no-size", 2, "invalid-presentation"), ("lost-id", 2, "missing-presentation-relationship"),
    ):
        row = done["summary"][f"in/{name}.pptx"]
        assert (name, row.exit_code, row.complete) == (name, code, False)
        assert (name, {c for k, c in done["diagnostics"] if k == f"in/{name}.pptx"}) == (name, set(found))


def test_no_text_leaks(done):
    assert not any(x in str(done["rows"]) for x in ("Small print", "Shrunk to fit", "Half gone"))


def test_lifecycle(spark, tmp_path):
    """Suppressions first, then the baseline; only new findings fail a command."""
    for name in ("golden", "clean"):
        (tmp_path / f"{name}.PPTX").write_bytes(DECKS[name])
    files = decks.scan(spark, str(tmp_path))
    assert {r.input_key for r in files.collect()} == {"golden.PPTX", "clean.PPTX"}
    f = inspection.facts(files)
    plain = config.resolve()
    found, _ = inspection.classified(inspection.suppressed(inspection.findings(f, plain), plain), None, files)
    keys = [(r.input_key, r.fingerprint) for r in found.where("rule_id LIKE 'text/%'").collect()]
    baseline = spark.createDataFrame([*keys, ("golden.PPTX", "gone")], "input_key string, fingerprint string")
    quiet = config.resolve({"extends": ["recommended"], "ignore": [{"rule": "text/min-font-size", "slide": 2}, {"rule": "text/min-font-size", "shapeIds": [2], "file": "golden.PPTX"}, {"rule": "text/min-font-size", "slide": 1}]})
    found, resolved = inspection.classified(inspection.suppressed(inspection.findings(f, quiet), quiet), baseline, files)
    got = {r.rule_id: (r.suppressed_by, r.status) for r in found.collect()}
    assert got["text/min-font-size"][0] == 1 and got["text/autofit-scale-below-minimum"] == (None, "existing") and got["layout/outside-slide"] == (None, "new")
    assert resolved.count() == 2  # the one that is gone, and the one that is suppressed now
    total = inspection.summary(f, found, quiet, resolved).where("input_key IS NULL").first()
    assert (total.exit_code, total.suppressed, total.existing, total.new_warnings) == (0, 1, 1, 1)
