import json

import pytest

from foliograph.plans import config, reports
from foliograph.sources import fixtures
from foliograph.streaming import drop_folder


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("a.pptx", "text/min-font-size", "error", "new", 'Says "9pt"', "p.xml", 1, "256", [2], '{"x":1}', "f1", None), ("a.pptx", "layout/text-overlap", "warning", "existing", "m", "p.xml", None, None, None, "{}", "f2", None),
        ("b.pptx", "text/min-font-size", "error", "new", "m", "p.xml", 1, "256", [3], "{}", "f3", 0),
    ]
    return spark.createDataFrame(rows, "input_key string, rule_id string, severity string, status string, message string, part string, slide_number int, slide_id string, shape_ids array<bigint>, evidence string, fingerprint string, suppressed_by int")


def test_lines(found):
    lines = {r.fingerprint: json.loads(r.value) for r in reports.json_lines(found).collect()}
    assert lines["f1"]["message"] == 'Says "9pt"' and lines["f1"]["location"] == {"part": "p.xml", "shapeIds": [2], "slideId": "256", "slideNumber": 1} and lines["f1"]["evidence"] == {"x": 1}
    assert lines["f2"]["location"]["slideNumber"] is None
    results = [json.loads(r.value) for r in reports.sarif_results(found).collect()]
    assert sorted(r["baselineState"] for r in results) == ["new", "unchanged"] and all(r["locations"][0]["physicalLocation"] for r in results)
    assert [r.value for r in reports.text_lines(found).collect()] == ['a.pptx  error  slide 1  text/min-font-size  Says "9pt"']
    assert {r.fingerprint for r in reports.baseline(found).collect()} == {"f1", "f2"}


def test_files(found, tmp_path):
    reports.write(reports.json_lines(found), str(tmp_path / "out"))
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("part-*")) == 3
    target = tmp_path / "r.txt"
    reports.write_whole(str(target), "one", [])
    reports.write_whole(str(target), "two", [str(tmp_path / "none")])
    assert target.read_text() == "two" and [p.name for p in tmp_path.iterdir() if p.is_file()] == ["r.txt"]
    with pytest.raises(ValueError):
        reports.write_whole(str(target), "x", [str(target)])
    assert target.read_text() == "two"


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/deck.pptx").write_bytes(fixtures.golden())
    query = drop_folder.inspect_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), config.resolve({"rules": {"text/min-font-size": "error"}}))
    query.awaitTermination(200)
    assert query.exception() is None
    assert [(r.input_key, r.rule_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("deck.pptx", "text/min-font-size")]
