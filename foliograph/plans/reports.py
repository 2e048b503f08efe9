"""Sinks of an inspection: JSON, SARIF and text made as columns, and single files written whole."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import canonical as C
from foliograph.plans.config import RULES


def json_lines(found: DataFrame) -> DataFrame:
    """One JSON object per finding, in canonical order within an input; see write for many files."""
    location = C.json_object(part=C.json_text(F.col("part")), slideNumber=C.json_number(F.col("slide_number")), slideId=C.json_text(F.col("slide_id")), shapeIds=C.json_list(F.transform(F.coalesce("shape_ids", F.array().cast("array<bigint>")), lambda x: x.cast("string"))))
    line = C.json_object(ruleId=C.json_text(F.col("rule_id")), severity=C.json_text(F.col("severity")), status=C.json_text(F.col("status")), message=C.json_text(F.col("message")), inputKey=C.json_text(F.col("input_key")), location=location, evidence=F.col("evidence"), fingerprint=C.json_text(F.col("fingerprint")))
    return found.select("input_key", "rule_id", "part", "slide_number", "fingerprint", line.alias("value"))


def sarif_results(found: DataFrame) -> DataFrame:
    """A SARIF 2.1.0 result per finding that isn't suppressed."""
    level = F.when(F.col("severity") == "error", F.lit('"error"')).otherwise(F.lit('"warning"'))
    state = F.when(F.col("status") == "existing", F.lit('"unchanged"')).otherwise(F.lit('"new"'))
    place = C.json_list(F.array(C.json_object(physicalLocation=C.json_object(artifactLocation=C.json_object(uri=C.json_text(F.col("input_key")))), logicalLocations=C.json_list(F.array(C.json_object(fullyQualifiedName=C.json_text(F.col("part"))))))))
    value = C.json_object(ruleId=C.json_text(F.col("rule_id")), level=level, baselineState=state, message=C.json_object(text=C.json_text(F.col("message"))), locations=place, partialFingerprints=C.json_object(**{"finding/v1": C.json_text(F.col("fingerprint"))}))
    return found.where("suppressed_by IS NULL").select("input_key", "rule_id", value.alias("value"))


def text_lines(found: DataFrame) -> DataFrame:
    """A line for each new finding that isn't suppressed."""
    line = F.format_string("%s  %s  slide %s  %s  %s", "input_key", "severity", F.coalesce(F.col("slide_number").cast("string"), F.lit("-")), "rule_id", "message")
    return found.where("suppressed_by IS NULL AND status = 'new'").select("input_key", "rule_id", "part", "slide_number", "fingerprint", line.alias("value"))


#: What a rule looks for, as SARIF describes it.
SHORT = {
    "fonts/allowed": "A typeface isn't on the list.", "layout/outside-slide": "A shape reaches over the slide's edge.", "layout/text-occluded": "An opaque shape covers text.", "layout/text-overlap": "Text frames overlap.",
    "package/broken-relationship": "A relationship's target is missing.", "package/malformed-xml": "XML can't be read safely.", "package/missing-media": "Media are missing.", "text/autofit-enabled": "Autofit is on without a stored scale.",
    "text/autofit-scale-below-minimum": "A stored scale makes text too small.", "text/min-font-size": "Text is too small.",
}
#: The documents' versions, the schema, and the media type of packages.
REPORT_VERSION, BASELINE_VERSION, TOOL_MAJOR = 1, 3, 0
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"
PACKAGE_TYPE = "application/vnd.openxmlformats-officedocument.presentationml.presentation"


def _present(**values: Column) -> Column:
    """A JSON object without the keys whose JSON is null."""
    pairs = [F.when(v.isNotNull() & (v != "null"), F.concat(F.lit(f'"{k}":'), v)) for k, v in values.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def location() -> Column:
    ids = F.when(F.size("shape_ids") > 0, C.json_list(F.transform("shape_ids", lambda x: x.cast("string"))))
    return _present(part=C.json_text(F.col("part")), slideNumber=C.json_number(F.col("slide_number")), slideId=C.json_text(F.col("slide_id")), shapeIds=ids, paragraphIndex=C.json_number(F.col("paragraph")), runIndex=C.json_number(F.col("run")))


def finding() -> Column:
    return C.json_object(ruleId=C.json_text(F.col("rule_id")), severity=C.json_text(F.col("severity")), status=C.json_text(F.col("status")), message=C.json_text(F.col("message")), file=C.json_text(F.col("file")), location=location(), evidence=F.col("evidence"), fingerprint=C.json_text(F.col("fingerprint")))


def _sorted_by_input(rows: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """name: the values of an input as one JSON list, in order. A package's findings are bounded by its size."""
    key = lambda o: F.coalesce(F.col(o), F.lit(0)) if dict(rows.dtypes)[o] in ("int", "bigint") else C.text_order(F.coalesce(F.col(o), F.lit("")))
    each = rows.select("input_key", F.struct(*[key(o).alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")).alias("s"))
    return each.groupBy("input_key").agg(C.json_list(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"])).alias(name))


#: The order of findings in a document.
ORDER = ("rule_id", "part", "slide_number", "fingerprint")


def documents(done: dict[str, DataFrame]) -> DataFrame:
    """input_key, document: the whole JSON report of each input of an inspection (see inspection.inspect)."""
    f = done["facts"]
    found = done["findings"].join(f.files.select("input_key", "file"), "input_key")
    live, quiet = found.where("suppressed_by IS NULL"), found.where("suppressed_by IS NOT NULL")
    diagnostic = C.json_object(code=C.json_text(F.col("code")), message=C.json_text(F.col("message")), partName=C.json_text(F.col("part")), relationshipId=C.json_text(F.col("rel_id")))
    lists = [
        _sorted_by_input(live, finding(), "findings", *ORDER), _sorted_by_input(quiet, C.json_object(finding=finding(), suppressionIndex=C.json_number(F.col("suppressed_by"))), "suppressedFindings", *ORDER),
        _sorted_by_input(done["unused"], C.json_object(ruleId=C.json_text(F.col("rule_id")), suppressionIndex=C.json_number(F.col("idx"))), "unusedSuppressions", "idx"),
        _sorted_by_input(done["diagnostics"], diagnostic, "diagnostics", "part", "code", "rel_id", "message"), _sorted_by_input(done["skipped"], C.json_text(F.col("rule_id")), "skippedRules", "rule_id"),
    ]
    if done["resolved"] is not None:
        lists.append(_sorted_by_input(done["resolved"], C.json_object(fingerprint=C.json_text(F.col("fingerprint"))), "resolvedFindings", "fingerprint"))
    rows = f.files.where("input_key IS NOT NULL").select("input_key", "file", "source_sha256").join(done["summary"].where("input_key IS NOT NULL"), "input_key")
    for df in lists:
        rows = rows.join(df.withColumnRenamed(df.columns[1], f"_{df.columns[1]}"), "input_key", "left")
    rows = rows if "_resolvedFindings" in rows.columns else rows.withColumn("_resolvedFindings", F.lit(None).cast("string"))
    held = {n: F.coalesce(f"_{n}", F.lit("[]")) for n in ("findings", "suppressedFindings", "unusedSuppressions", "resolvedFindings", "diagnostics", "skippedRules")}
    count = lambda e, w: C.json_object(errors=C.json_number(e), warnings=C.json_number(w), total=C.json_number(e + w))
    n = F.col
    tally = C.json_object(errors=C.json_number(n("errors")), warnings=C.json_number(n("warnings")), total=C.json_number(n("total")), new=count(n("new_errors"), n("new_warnings")), existing=C.json_number(n("existing")), resolved=C.json_number(n("resolved")), suppressed=C.json_number(n("suppressed")))
    of = C.json_object(file=C.json_text(n("file")), inputKey=C.json_text(n("input_key")), sourceSha256=C.json_text(n("source_sha256")))
    return rows.select("input_key", C.json_object(schemaVersion=F.lit(str(REPORT_VERSION)), input=of, analysisComplete=n("complete").cast("string"), summary=tally, **held).alias("document"))


def _indented(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def command_report(reports: Iterable[dict], config_hash: str, timings: dict[str, float] | None = None, peak: int | None = None) -> dict:
    """The report of a command from its inputs' documents, ordered by input key, source and file. Small: one command's packages."""
    units = lambda s: s.encode("utf-16-be", "surrogatepass")
    inputs = sorted(reports, key=lambda r: (units(r["input"]["inputKey"]), r["input"]["sourceSha256"], units(r["input"]["file"])))
    total: dict[str, object] = {}
    for r in inputs:
        for k, v in r["summary"].items():
            total[k] = {x: total.get(k, {}).get(x, 0) + y for x, y in v.items()} if isinstance(v, dict) else total.get(k, 0) + v
    out = {"schemaVersion": REPORT_VERSION, "configHash": config_hash, "analysisComplete": all(r["analysisComplete"] for r in inputs), "summary": total, "timingsMs": {k: round(v, 3) for k, v in sorted((timings or {}).items())}, "inputs": inputs}
    return out if peak is None else out | {"peakRssBytes": peak}


def _named(place: dict) -> str:
    ids = place.get("shapeIds", [])
    parts = [f"slide {place['slideNumber']}"] if "slideNumber" in place else []
    parts += [f"shape{'s' * (len(ids) > 1)} {', '.join(map(str, ids))}"] if ids else []
    parts += [f"{word} {place[k]}" for k, word in (("paragraphIndex", "paragraph"), ("runIndex", "run")) if k in place]
    return " / ".join(parts) or (f"part {place['part']}" if "part" in place else "package")


def sarif_input(r: dict, i: int) -> tuple[dict, list[dict]]:
    """The artifact of an input's document, whose place is i, and a result for each of its findings that isn't suppressed."""
    at = {k: n for n, k in enumerate(RULES)}
    key = r["input"]["inputKey"]
    where = {"uri": quote(key, safe="/!'()*~"), "uriBaseId": "%SRCROOT%", "index": i}
    artifact = {"location": where, "roles": ["analysisTarget"], "mimeType": PACKAGE_TYPE, "hashes": {"sha-256": r["input"]["sourceSha256"]}, "properties": {"inputKey": key, "analysisComplete": r["analysisComplete"], "skippedRules": r["skippedRules"], "diagnostics": r["diagnostics"]}}
    results = []
    for f in r["findings"]:
        place = f["location"]
        whole = ";".join(f"{n}={','.join(map(str, v)) if isinstance(v, list) else v}" for n, v in place.items()) or "package"
        kind = "element" if "slideNumber" in place else "module" if "part" in place else "resource"
        logical = {"name": _named(place), "fullyQualifiedName": f"{key}#{whole}", "kind": kind, "properties": place}
        results.append({"ruleId": f["ruleId"], "ruleIndex": at[f["ruleId"]], "kind": "fail", "level": f["severity"], "message": {"text": f["message"]}, "locations": [{"physicalLocation": {"artifactLocation": where}, "logicalLocations": [logical]}], "partialFingerprints": {"finding/v1": f["fingerprint"]}, "properties": {"status": f["status"], "evidence": f["evidence"]}})
    return artifact, results


def sarif(report: dict) -> dict:
    """A SARIF 2.1.0 log: one run with all rules, and the artifacts and results of the inputs."""
    rules = [{"id": k, "shortDescription": {"text": SHORT[k]}, "defaultConfiguration": {"enabled": v[0] != "off", "level": "none" if v[0] == "off" else v[0]}} for k, v in RULES.items()]
    each = [sarif_input(r, i) for i, r in enumerate(report["inputs"])]
    properties = {k: report[k] for k in ("schemaVersion", "configHash", "analysisComplete", "summary", "timingsMs")}
    return {"version": "2.1.0", "$schema": SARIF_SCHEMA, "runs": [{"tool": {"driver": {"name": "foliograph", "rules": rules}}, "artifacts": [a for a, _ in each], "results": [x for _, own in each for x in own], "properties": properties}]}


def stylish(report: dict) -> str:
    """Text for people: new findings of each input, counts, and what was suppressed, is resolved, or suppresses nothing."""
    out = []
    for r in report["inputs"]:
        new, s = [f for f in r["findings"] if f["status"] == "new"], r["summary"]
        rest = [(s["existing"], "existing"), (s["resolved"], "resolved"), (s["suppressed"], "suppressed"), (len(r["unusedSuppressions"]), "unused suppressions")]
        if not new and not any(n for n, _ in rest):
            continue
        out.append(r["input"]["file"] + "\n")
        out += [f"  {_named({k: v for k, v in f['location'].items() if k not in ('paragraphIndex', 'runIndex')})}\n  {f['severity']:7} {f['ruleId']}\n  {f['message']}\n" for f in new]
        counts = s["new"]
        out.append(f"{counts['total']} new ({counts['errors']} errors, {counts['warnings']} warnings)" if new else "Nothing new")
        out += ["  " + ", ".join(f"{n} {what}" for n, what in rest if n)] if any(n for n, _ in rest) else []
        out += [f"  unused suppression ignore[{u['suppressionIndex']}] ({u['ruleId']})" for u in r["unusedSuppressions"]] + [""]
    return "".join(line + "\n" for line in out)


FORMATS = {"json": _indented, "sarif": lambda r: _indented(sarif(r)), "stylish": stylish}


class BaselineError(ValueError):
    pass


def baseline_document(reports: Iterable[dict]) -> dict:
    """What a later command compares with: the findings of any status, not the suppressed ones, by input and fingerprint."""
    inputs: dict[str, tuple[str, dict]] = {}
    for r in reports:
        key, source = r["input"]["inputKey"], r["input"]["sourceSha256"]
        held = inputs.setdefault(key, (source, {}))
        if held[0] != source:
            raise BaselineError(f"two files of different content have the key {key}")
        held[1].update({f["fingerprint"]: {"fingerprint": f["fingerprint"], "ruleId": f["ruleId"], "location": f["location"]} for f in r["findings"]})
    return {"schemaVersion": BASELINE_VERSION, "toolMajorVersion": TOOL_MAJOR, "inputs": [{"inputKey": k, "findings": [v[1][x] for x in sorted(v[1])]} for k, v in sorted(inputs.items())]}


def read_baseline(text: str) -> list[tuple[str, str]]:
    """(input key, fingerprint) of a baseline document; BaselineError where it isn't one."""
    try:
        given = json.loads(text)
    except ValueError as e:
        raise BaselineError(f"the baseline is no JSON: {e}") from None

    def checked(value: object, what: str, *keys: str) -> dict:
        if not isinstance(value, dict) or set(value) != set(keys):
            raise BaselineError(f"{what} must have {', '.join(keys)} and nothing else")
        return value

    checked(given, "the baseline", "schemaVersion", "toolMajorVersion", "inputs")
    if given["schemaVersion"] != BASELINE_VERSION or given["toolMajorVersion"] != TOOL_MAJOR or not isinstance(given["inputs"], list):
        raise BaselineError("the baseline has another version, or no list of inputs")
    out: list[tuple[str, str]] = []
    for i, one in enumerate(given["inputs"]):
        key = checked(one, f"input {i}", "inputKey", "findings")["inputKey"]
        if not isinstance(key, str) or not key or key.startswith("/") or ".." in key.split("/") or not isinstance(one["findings"], list):
            raise BaselineError(f"input {i} has no valid key or no list of findings")
        for n, f in enumerate(one["findings"]):
            checked(f, f"finding {n} of input {i}", "fingerprint", "ruleId", "location")
            if not isinstance(f["fingerprint"], str) or not re.fullmatch("[a-f0-9]{64}", f["fingerprint"]) or f["ruleId"] not in RULES:
                raise BaselineError(f"finding {n} of input {i} has no valid fingerprint or rule")
            if not isinstance(f["location"], dict) or set(f["location"]) - {"part", "slideNumber", "slideId", "shapeIds", "paragraphIndex", "runIndex"}:
                raise BaselineError(f"finding {n} of input {i} has no valid location")
            out.append((key, f["fingerprint"]))
    if len(set(out)) < len(out) or len({one["inputKey"] for one in given["inputs"]}) < len(given["inputs"]):
        raise BaselineError("an input or a fingerprint repeats")
    return out


def write(lines: DataFrame, folder: str) -> None:
    """Writes report lines as text, sorted in each file; every input's lines are in one file."""
    lines.repartition("input_key").sortWithinPartitions("input_key", "rule_id", "part", "slide_number", "fingerprint").select("value").write.mode("overwrite").text(folder)


def write_whole(path: str, text: str, inputs: list[str]) -> None:
    """Replaces one local file at once; refuses to replace any of the inputs."""
    if any(os.path.exists(path) and os.path.exists(i) and os.path.samefile(path, i) for i in inputs):
        raise ValueError("the output is one of the inputs")
    handle, draft = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise


def baseline(found: DataFrame) -> DataFrame:
    """What a later run compares with: the fingerprints of findings that aren't suppressed, of any status."""
    return found.where("suppressed_by IS NULL").select("input_key", "fingerprint", "rule_id", "part").distinct()


#: Buckets of a baseline's table.
BUCKETS = 64


def save_baseline(found: DataFrame, files: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """The baseline as a table in buckets by input and fingerprint: a later run compares with it where it lies (see inspection.classified).

    files: input_key, source_sha256. BaselineError where two files of different content have one key.
    """
    twice = files.groupBy("input_key").agg(F.count_distinct("source_sha256").alias("n")).where("n > 1 AND input_key IS NOT NULL").first()
    if twice:
        raise BaselineError(f"two files of different content have the key {twice.input_key}")
    keys = ("input_key", "fingerprint")
    baseline(found).repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("overwrite").saveAsTable(table)
