"""Packages as a data source that reads by ranges: `spark.read.format("presentation_packages")`.

    spark.read.format("presentation_packages").option("path", folder).load()                    # entries
    spark.read.format("presentation_packages").option("path", folder).option("rows", "files")   # files and their hashes

Of a package its end record and directory are read, and of its members those that are asked for; nothing else. A large
package is cut into ranges; its entries belong to the range in which their local records start, so that its members are read
by as many tasks. Paths are those of any file system that pyarrow knows (file, hdfs, s3, gs, abfs).

Options: path (a folder or a file) or paths (a JSON list); rows, entries or files; content, none, xml or all: whose bytes are
read (members beyond the limits never are); names, a pattern like ppt/slides/* of entries' names; split, bytes of a range;
pushdown, true to take filters of the query on file and raw_name (it needs spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import contextlib
import fnmatch
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliograph.sources import zip_entries

NAME = "presentation_packages"
FILES = "file STRING, uri STRING, size LONG, source_sha256 STRING"
ENTRIES = "file STRING, uri STRING, size LONG, zip_error STRING, idx INT, raw_name STRING, method INT, csize LONG, usize LONG, crc LONG, encrypted BOOLEAN, denied STRING, read_error STRING, content BINARY"
#: Bytes of a range, and of a file's part that is hashed at a time; files of a task together have at most a range's bytes, or so many.
SPLIT, CHUNK, TOGETHER = 64 << 20, 8 << 20, 64


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextlib.contextmanager
def opened(uri: str) -> Iterator[zip_entries.Ranged]:
    system, path = located(uri)
    with system.open_input_file(path) as file:
        yield zip_entries.Ranged(file)


def listed(where: list[str]) -> list[tuple[str, str, int]]:
    """file, uri, size of the packages in folders and files; file is relative to the folder."""
    out = []
    for uri in where:
        system, path = located(uri)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        if info.type == fs.FileType.File:
            out.append((path.rpartition("/")[2], uri, info.size))
            continue
        base = path.rstrip("/")
        for f in system.get_file_info(fs.FileSelector(base, recursive=True)):
            if f.type == fs.FileType.File and f.path.lower().endswith(".pptx"):
                out.append((f.path[len(base) :].lstrip("/"), uri.rstrip("/") + "/" + f.path[len(base) :].lstrip("/") if system.type_name != "local" else f.path, f.size))
    return sorted(out)


def there(uri: str) -> None:
    system, path = located(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)


def children(file: str, uri: str) -> Iterator[tuple[str, str, int | None]]:
    """file, uri and size of the packages in a folder, and its folders, with a null size; file is relative to where the listing began.

    A local folder is read as a stream. Of an address of a file, that file.
    """
    system, path = located(uri)
    local = system.type_name == "local"
    base, above = path.rstrip("/") or "/", file + "/" if file else ""
    if not file and (info := system.get_file_info(base)).type == fs.FileType.File:
        yield base.rpartition("/")[2], uri, info.size
        return
    if local:
        with os.scandir(base) as found:
            for e in found:
                if e.is_dir():
                    yield above + e.name, e.path, None
                elif e.is_file() and e.name.lower().endswith(".pptx"):
                    yield above + e.name, e.path, e.stat().st_size
        return
    for f in system.get_file_info(fs.FileSelector(base)):
        name = f.path.rstrip("/").rpartition("/")[2]
        if f.type == fs.FileType.Directory:
            yield above + name, f"{uri.rstrip('/')}/{name}", None
        elif f.type == fs.FileType.File and name.lower().endswith(".pptx"):
            yield above + name, f"{uri.rstrip('/')}/{name}", f.size


def hashed(uri: str) -> str:
    """SHA-256 of a file, read as a stream."""
    system, path = located(uri)
    digest = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while data := stream.read(CHUNK):
            digest.update(data)
    return digest.hexdigest()


@dataclass
class Ranges(InputPartition):
    """Ranges of files that a task reads: file, uri, size, first and last byte."""

    parts: list[tuple[str, str, int, int, int]]


def dealt(files: list[tuple[str, str, int]], split: int) -> list[Ranges]:
    """Large files by ranges, small ones together."""
    out, held, size = [], [], 0
    for file, uri, length in files:
        if length > split:
            out += [Ranges([(file, uri, length, at, min(length, at + split))]) for at in range(0, length, split)]
            continue
        held.append((file, uri, length, 0, length))
        size += length
        if size >= split or len(held) >= TOGETHER:
            out.append(Ranges(held))
            held, size = [], 0
    return [*out, Ranges(held)] if held else out


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.schema = to_arrow_schema(schema)
        self.where = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.rows, self.content, self.names = options.get("rows", "entries"), options.get("content", "none"), options.get("names")
        self.split = int(options.get("split", SPLIT))
        if self.rows not in ("entries", "files") or self.content not in ("none", "xml", "all") or self.split <= 0:
            raise ValueError("rows must be entries or files, content none, xml or all, and split positive")
        self.wanted: list[tuple[str, Callable[[str], bool]]] = []

    def partitions(self) -> list[Ranges]:
        files = [f for f in listed(self.where) if self._fits("file", f[0])]
        return dealt(files, self.split if self.rows == "entries" else 1 << 62) or [Ranges([])]

    def _fits(self, column: str, value: str) -> bool:
        return all(test(value) for c, test in self.wanted if c == column)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from foliograph.sources import decks  # decks has a scan of this source

        if self.rows == "files":
            yield from decks.batched((self._hashed(*p[:3]) for p in partition.parts), self.schema)
            return
        for file, uri, size, low, high in partition.parts:
            with opened(uri) as source:
                yield from decks.batched(({"file": file, "uri": uri, "size": size, **r} for r in self._entries(decks, source, low, high)), self.schema)

    def _hashed(self, file: str, uri: str, size: int) -> dict:
        return {"file": file, "uri": uri, "size": size, "source_sha256": hashed(uri)}

    def _entries(self, decks, source: zip_entries.Bytes, low: int, high: int) -> Iterator[dict]:
        try:
            package = decks.Package(source, decks.LIMITS)
        except (zip_entries.ZipError, ValueError) as e:
            if low == 0 and not self.names and not any(c == "raw_name" for c, _ in self.wanted):
                yield {"zip_error": str(e), "idx": -1}
            return
        for e in package.entries:
            if not low <= e.offset < max(high, 1) or self.names and not fnmatch.fnmatchcase(e.name, self.names) or not self._fits("raw_name", e.name):
                continue
            row = {"idx": e.idx, "raw_name": e.name, "method": e.method, "csize": e.csize, "usize": e.usize, "crc": e.crc, "encrypted": bool(e.flags & 1), "denied": package.denied(e, package.is_xml(e))}
            if not row["denied"] and not e.name.endswith("/") and (self.content == "all" or self.content == "xml" and package.is_xml(e)):
                row["content"], row["read_error"] = package.read(e)
            yield row


class FilteringReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on file and raw_name; the others stay with Spark."""
        tests = {EqualTo: lambda v: lambda x: x == v, In: lambda v: lambda x: x in v, StringStartsWith: lambda v: lambda x: x.startswith(v), StringEndsWith: lambda v: lambda x: x.endswith(v)}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("file", "raw_name") and type(f) in tests:
                self.wanted.append((column, tests[type(f)](f.value)))
            else:
                yield f


class Packages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILES if self.options.get("rows") == "files" else ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown", "").lower() == "true" else Reader)(options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Packages)
