"""One report of any number of packages, written by the executors and committed at once.

Each task writes its part of the report's lists beside the target; the commit joins the parts by copying them, in order, into
a draft that then takes the target's place. The driver holds no document, and a run that fails leaves the target as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from foliograph.functions import canonical as C
from foliograph.operators import relational
from foliograph.plans import reports
from foliograph.plans.config import Config, digest
from foliograph.sources.ranged import located

NAME = "joined_report"
#: Bytes that the commit copies at a time.
CHUNK = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """Where a task's items begin in the order, and how many items its part of each list has."""

    place: int
    name: str
    counts: list[int]


class Writer(DataSourceWriter):
    """Rows of place, items (for each list its JSON items, joined by commas, or an empty string), sorted in each task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.texts = options["path"], json.loads(options["texts"])  # before, between and after the lists
        self.staging = f"{self.path}.{options['run']}"

    def write(self, iterator: Iterator[Row]) -> Part:
        system, base = located(self.staging)
        system.create_dir(base, recursive=True)
        name, place, counts = uuid.uuid4().hex, -1, [0] * (len(self.texts) - 1)
        outs = [system.open_output_stream(f"{base}/{name}.{n}") for n in range(len(counts))]
        for row in iterator:
            place = row.place if place < 0 else place
            for n, items in enumerate(row["items"]):
                if items:
                    outs[n].write((("," if counts[n] else "") + items).encode("utf-8", "surrogatepass"))
                    counts[n] += 1
        for out in outs:
            out.close()
        return Part(place, name, counts)

    def commit(self, messages: list[Part | None]) -> None:
        system, base = located(self.staging)
        parts = sorted((m for m in messages if m and m.place >= 0), key=lambda m: m.place)
        draft = f"{base}/draft"
        system.create_dir(base, recursive=True)
        with system.open_output_stream(draft) as out:
            for n, text in enumerate(self.texts):
                out.write(text.encode("utf-8", "surrogatepass"))
                if n < len(self.texts) - 1:
                    self._join(system, base, [p for p in parts if p.counts[n]], n, out)
        system.move(draft, located(self.path)[1])
        system.delete_dir(base)

    @staticmethod
    def _join(system: fs.FileSystem, base: str, parts: list[Part], n: int, out: pa.NativeFile) -> None:
        for i, part in enumerate(parts):
            if i:
                out.write(b",")
            with system.open_input_stream(f"{base}/{part.name}.{n}") as own:
                while data := own.read(CHUNK):
                    out.write(data)

    def abort(self, messages: list[Part | None]) -> None:
        system, base = located(self.staging)
        if system.get_file_info(base).type != fs.FileType.NotFound:
            system.delete_dir(base)


class JoinedReport(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "place LONG, items ARRAY<STRING>"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options))


def placed(done: dict[str, DataFrame]) -> DataFrame:
    """input_key, document, place (from 0): the documents in the order of their keys' code units, hashes and files."""
    rows = reports.documents(done).join(done["facts"].files.select("input_key", "source_sha256", "file"), "input_key")
    rows = rows.withColumn("k", C.text_order(F.col("input_key")))
    return relational.places(rows, [], ["k", "source_sha256", "file"], "place").select("input_key", "document", (F.col("place") - 1).alias("place"))


def _write(rows: DataFrame, path: str, texts: list[str]) -> None:
    rows.sparkSession.dataSource.register(JoinedReport)
    ordered = rows.repartitionByRange("place").sortWithinPartitions("place")
    ordered.write.format(NAME).mode("append").option("path", path).option("texts", json.dumps(texts)).option("run", uuid.uuid4().hex).save()


def _totals(done: dict[str, DataFrame], config: Config) -> dict:
    """What a report says of the whole command."""
    s = done["summary"].where("input_key IS NULL").first()
    count = lambda e, w: {"errors": e, "warnings": w, "total": e + w}
    summary = {"errors": s.errors, "warnings": s.warnings, "total": s.total, "new": count(s.new_errors, s.new_warnings), "existing": s.existing, "resolved": s.resolved, "suppressed": s.suppressed}
    return {"schemaVersion": reports.REPORT_VERSION, "configHash": digest(config), "analysisComplete": s.complete, "summary": summary, "timingsMs": {}}


def _around(value: dict, *lists: str) -> list[str]:
    """The text of value before, between and after its lists, which are empty in it and stand in this order."""
    out, rest = [], json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    for name in lists:
        before, mark, rest = rest.partition(f'"{name}":[')
        out.append(before + mark)
    return [*out, rest]


def write_json(done: dict[str, DataFrame], config: Config, path: str) -> None:
    """The JSON report of an inspection (see inspection.inspect)."""
    rows = placed(done).select("place", F.array("document").alias("items"))
    _write(rows, path, _around({**_totals(done, config), "inputs": []}, "inputs"))


def write_sarif(done: dict[str, DataFrame], config: Config, path: str) -> None:
    """The SARIF log of an inspection: artifacts have the documents' places, and results name them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dumped = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        for batch in batches:
            items = []
            for place, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                artifact, results = reports.sarif_input(json.loads(document), place)
                items.append([dumped(artifact), ",".join(map(dumped, results))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.string()))], ["place", "items"])

    rows = placed(done).select("place", "document").mapInArrow(run, "place long, items array<string>")
    _write(rows, path, _around(reports.sarif({**_totals(done, config), "inputs": []}), "artifacts", "results"))
