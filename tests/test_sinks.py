"""Whole reports written by executors."""

import json
import uuid

import pytest

from foliograph.plans import config, inspection, reports, sinks
from foliograph.sources import decks, fixtures
from pyspark.sql import functions as F

NAMES = ["\uff5e", "\U0001f600", "a", "z", *map(str, range(20))]


@pytest.fixture(scope="module")
def done(spark):
    rows = [(f"{n}.pptx", fixtures.generated(i, 7)) for i, n in enumerate(NAMES)]
    return inspection.inspect(decks.decks(spark.createDataFrame(rows, "file string, content binary").repartition(5)), config.resolve())


def test_json_and_sarif_as_the_driver_would_write_them(done, tmp_path):
    each = [json.loads(r.document) for r in reports.documents(done).collect()]
    want = reports.command_report(each, config.digest(config.resolve()))
    sinks.write_json(done, config.resolve(), str(tmp_path / "report.json"))
    got = json.loads((tmp_path / "report.json").read_text())
    assert got == want and [x["input"]["file"] for x in got["inputs"]][-2:] == ["\U0001f600.pptx", "\uff5e.pptx"]
    sinks.write_sarif(done, config.resolve(), str(tmp_path / "log.sarif"))
    log = json.loads((tmp_path / "log.sarif").read_text())
    assert log == reports.sarif(want) and len(log["runs"][0]["results"]) > 5
    assert sorted(p.name for p in tmp_path.iterdir()) == ["log.sarif", "report.json"]


def test_baseline_in_buckets_does_not_move(spark, done):
    """A later run finds the same findings existing; the baseline's side of the plan has no exchange."""
    name = f"baseline_{uuid.uuid4().hex}"
    reports.save_baseline(done["findings"], done["facts"].files, name, buckets=3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = done["findings"].drop("status")
        gone = spark.createDataFrame([("a.pptx", "0" * 64), ("elsewhere.pptx", "1" * 64)], "input_key string, fingerprint string")
        found, resolved = inspection.classified(fresh, spark.table(name), done["facts"].files)
        assert {r.status for r in found.collect()} == {"existing"} and resolved.count() == 0
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, line in enumerate(plan) if name in line and "Scan" in line)
        depth = next(i for i, c in enumerate(plan[scan]) if c.isalpha() or c == "*")
        above = []
        for line in reversed(plan[:scan]):
            own = next((i for i, c in enumerate(line) if c.isalpha() or c == "*"), 0)
            if own < depth:
                above, depth = [*above, line], own
        join = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[:join])
        _, resolved = inspection.classified(fresh, gone, done["facts"].files)
        assert [tuple(r) for r in resolved.collect()] == [("a.pptx", "0" * 64)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"DROP TABLE {name}")
    two = spark.createDataFrame([("a", "1"), ("a", "2")], "input_key string, source_sha256 string")
    with pytest.raises(reports.BaselineError):
        reports.save_baseline(done["findings"], two, name)


def test_a_failed_run_leaves_the_target(spark, tmp_path):
    target = tmp_path / "r.json"
    target.write_text("old")
    rows = spark.range(8).select(F.col("id").alias("place"), F.array(F.when(F.col("id") < 7, "1").otherwise(F.raise_error(F.lit("lost")).cast("string"))).alias("items"))
    with pytest.raises(Exception, match="lost"):
        sinks._write(rows, str(target), ["[", "]"])
    assert target.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["r.json"]
    sinks._write(spark.range(2000).select(F.col("id").alias("place"), F.array(F.col("id").cast("string")).alias("items")), str(target), ["[", "]"])
    assert json.loads(target.read_text()) == list(range(2000))
    sinks._write(spark.range(0).select(F.col("id").alias("place"), F.array(F.col("id").cast("string")).alias("items")), str(target), ["[", "]"])
    assert json.loads(target.read_text()) == []
