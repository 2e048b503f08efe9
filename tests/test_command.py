"""The command line on a few packages in a folder."""

import io
import json

from foliograph.plans import command, config, reports
from foliograph.sources import fixtures


def ran(spark, folder, *args):
    out, err = io.StringIO(), io.StringIO()
    code = command.run([*args], spark, out, err, str(folder))
    return code, out.getvalue(), err.getvalue()


def test_reports_and_baseline(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "deck.pptx").write_bytes(fixtures.golden())
    code, text, err = ran(spark, tmp_path, "--format", "json", "--debug", "--write-baseline", "base.json", "deck.pptx")
    report = json.loads(text)
    one = report["inputs"][0]
    assert (code, err) == (1, "") and report["summary"]["new"] == {"errors": 2, "warnings": 1, "total": 3} and report["timingsMs"]["analysis"] >= report["timingsMs"]["context"] > 0 and {k for k in report["timingsMs"] if k.startswith("rule/")} == {f"rule/{r}" for r in config.resolve().enabled()} and report["peakRssBytes"] > 0
    assert [f["ruleId"] for f in one["findings"]] == ["layout/outside-slide", "text/autofit-scale-below-minimum", "text/min-font-size"] and one["input"]["inputKey"] == "deck.pptx"
    assert one["findings"][2]["location"] == {"part": "ppt/slides/slide1.xml", "slideNumber": 1, "slideId": "256", "shapeIds": [2], "paragraphIndex": 0, "runIndex": 0}
    base = json.loads((tmp_path / "base.json").read_text())
    assert base["schemaVersion"] == 3 and len(base["inputs"][0]["findings"]) == 3
    log = reports.sarif(report)["runs"][0]
    assert len(log["tool"]["driver"]["rules"]) == 10 and len(log["results"]) == 3 and log["artifacts"][0]["hashes"]["sha-256"] == one["input"]["sourceSha256"]
    assert log["results"][0]["locations"][0]["logicalLocations"][0]["fullyQualifiedName"].startswith("deck.pptx#part=ppt/slides/slide1.xml;slide")
    (tmp_path / "foliograph.json").write_text(json.dumps({"extends": ["recommended"], "ignore": [{"rule": "text/min-font-size", "slide": 1}, {"rule": "fonts/allowed", "slide": 1}]}))
    code, text, _ = ran(spark, tmp_path, "--baseline", "base.json", "deck.pptx")
    assert code == 0 and "Nothing new" in text and "2 existing, 1 resolved, 1 suppressed, 1 unused suppressions" in text and "unused suppression ignore[1] (fonts/allowed)" in text


def test_names_of_files(spark, tmp_path, monkeypatch):
    """Reports name files as they are seen from the working directory, keys encode them; those outside have their name."""
    (tmp_path / "in").mkdir()
    monkeypatch.chdir(tmp_path / "in")
    (tmp_path / "in/50% a.pptx").write_bytes(fixtures.golden())
    (tmp_path / "b.pptx").write_bytes(fixtures.golden())
    code, text, _ = ran(spark, tmp_path / "in", "--format", "json", "50% a.pptx", "../b.pptx")
    inputs = {x["input"]["file"]: x for x in json.loads(text)["inputs"]}
    assert code == 1 and set(inputs) == {"50% a.pptx", "b.pptx"}
    assert inputs["50% a.pptx"]["input"]["inputKey"] == "50%25 a.pptx" and inputs["b.pptx"]["input"]["inputKey"].startswith("external/") and inputs["b.pptx"]["input"]["inputKey"].endswith("/b.pptx")
    assert {f["file"] for f in inputs["b.pptx"]["findings"]} == {"b.pptx"}


def test_usage(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "deck.pptx").write_bytes(b"no zip")
    for args in ([], ["x.txt"], ["gone.pptx"], ["--bad", "deck.pptx"], ["--debug", "deck.pptx"], ["--baseline", "a", "--write-baseline", "b", "deck.pptx"], ["--format", "json", "--format", "json", "deck.pptx"], ["--config", "none.json", "deck.pptx"]):
        code, text, err = ran(spark, tmp_path, *args)
        assert (code, text) == (2, "") and err.startswith("foliograph: ")


def test_baselines_are_strict():
    good = {"schemaVersion": 3, "toolMajorVersion": 0, "inputs": [{"inputKey": "a", "findings": [{"fingerprint": "0" * 64, "ruleId": "fonts/allowed", "location": {}}]}]}
    assert reports.read_baseline(json.dumps(good)) == [("a", "0" * 64)]
    for change in (lambda g: g.update(schemaVersion=2), lambda g: g.update(more=1), lambda g: g["inputs"].append(g["inputs"][0]), lambda g: g["inputs"][0]["findings"][0].update(fingerprint="x"), lambda g: g["inputs"][0]["findings"][0].update(ruleId="x"), lambda g: g["inputs"][0].update(inputKey="../a"), lambda g: g["inputs"][0]["findings"][0]["location"].update(x=1)):
        bad = json.loads(json.dumps(good))
        change(bad)
        try:
            reports.read_baseline(json.dumps(bad))
        except reports.BaselineError:
            continue
        raise AssertionError(bad)
    one = {"input": {"inputKey": "a", "sourceSha256": "1"}, "findings": []}
    try:
        reports.baseline_document([one, {**one, "input": {"inputKey": "a", "sourceSha256": "2"}}])
    except reports.BaselineError:
        return
    raise AssertionError("two sources of one key")
