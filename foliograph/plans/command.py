"""The command line: inspects packages of a local folder in one Spark job and writes one report.

    python -m foliograph [options] FILE.pptx ...

Exit codes: 0, 1 for new findings as severe as failOn, 2 for analyses that nothing accounts for and for wrong usage.
"""

from __future__ import annotations

import argparse
import json
import os
import resource
import sys
import time
from typing import TextIO

from pyspark.sql import SparkSession

from foliograph.plans import config, inspection, reports
from foliograph.sources import decks

#: The configuration's file, looked for in the working directory and above it.
CONFIG_FILE = "foliograph.json"
INCOMPLETE = "analysis was incomplete, and no finding that fails the command accounts for it"


class UsageError(ValueError):
    pass


class _Once(argparse.Action):
    def __call__(self, parser, namespace, value, option_string=None):
        if getattr(namespace, f"_{self.dest}", False):
            raise UsageError(f"{option_string} may be given once")
        setattr(namespace, f"_{self.dest}", True)
        setattr(namespace, self.dest, value)


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def parsed(args: list[str]) -> argparse.Namespace:
    p = _Parser(prog="foliograph", description="Inspects presentation packages.", allow_abbrev=False)
    p.add_argument("inputs", nargs="+", metavar="FILE.pptx")
    p.add_argument("--baseline", action=_Once, metavar="FILE", help="findings of this document are existing ones")
    p.add_argument("--write-baseline", action=_Once, metavar="FILE", help="write a baseline of all findings")
    p.add_argument("--config", metavar="FILE")
    p.add_argument("--fail-on", choices=("warning", "error"))
    p.add_argument("--format", action=_Once, choices=sorted(reports.FORMATS), default="stylish")
    p.add_argument("--output-file", action=_Once, metavar="FILE")
    p.add_argument("--debug", action="store_true", help="put timings and memory into the report")
    given = p.parse_args(args)
    if given.baseline and given.write_baseline:
        raise UsageError("--baseline and --write-baseline exclude each other")
    if given.debug and given.format == "stylish":
        raise UsageError("--debug needs --format json or sarif")
    for path in given.inputs:
        if not path.lower().endswith(".pptx"):
            raise UsageError(f"{path} is no .pptx file")
        if not os.path.isfile(path):
            raise UsageError(f"{path} can't be read")
    return given


def found_config(cwd: str) -> str | None:
    """The nearest configuration at or above a folder."""
    while not os.path.isfile(os.path.join(cwd, CONFIG_FILE)):
        cwd, below = os.path.dirname(cwd), cwd
        if cwd == below:
            return None
    return os.path.join(cwd, CONFIG_FILE)


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise UsageError(f"{path} can't be read: {e}") from None


def run(args: list[str], spark: SparkSession | None = None, out: TextIO = sys.stdout, err: TextIO = sys.stderr, cwd: str | None = None) -> int:
    cwd = cwd or os.getcwd()
    try:
        given = parsed(args)
        path = given.config or found_config(cwd)
        try:
            settings = config.resolve(json.loads(_read(path)) if path else None, given.fail_on)
        except json.JSONDecodeError as e:
            raise UsageError(f"{path} is no JSON: {e}") from None
        baseline = reports.read_baseline(_read(given.baseline)) if given.baseline else None
        spark = spark or SparkSession.builder.appName("foliograph").getOrCreate()
        began = time.perf_counter()
        inputs = {p: (decks.shown_path(p, cwd), decks.cwd_key(p, cwd)) for p in (os.path.abspath(os.path.join(cwd, x)) for x in given.inputs)}
        spent = {} if given.debug else None
        old = spark.createDataFrame(baseline, "input_key string, fingerprint string") if baseline is not None else None
        done = inspection.inspect(decks.named(spark, inputs), settings, old, timings=spent)
        each = [json.loads(r.document) for r in reports.documents(done).select("document").toLocalIterator()]
        code = done["summary"].where("input_key IS NULL").first().exit_code
        timings = {**spent, "analysis": 1000 * (time.perf_counter() - began)} if given.debug else None
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024 if given.debug else None
        text = reports.FORMATS[given.format](reports.command_report(each, config.digest(settings), timings, peak))
        guarded = [*given.inputs, *[p for p in (path, given.baseline) if p]]
        if given.output_file:
            reports.write_whole(given.output_file, text, guarded)
        else:
            out.write(text)
        if code == 2:
            err.write(f"foliograph: {INCOMPLETE}\n")
        elif given.write_baseline:
            reports.write_whole(given.write_baseline, json.dumps(reports.baseline_document(each), indent=2) + "\n", guarded)
        return int(code)
    except (UsageError, ValueError) as e:
        err.write(f"foliograph: {e}\n")
        return 2
