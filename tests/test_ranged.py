"""Packages read by ranges, and parts that are parsed once."""

import os
import struct
import zipfile

import pytest

from foliograph.sources import decks, fixtures, ranged, zip_entries
from foliograph.sources.fixtures import package, text_shape, zipped
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    (root / "sub").mkdir()
    for n in range(6):
        (root / f"{n}.pptx").write_bytes(fixtures.generated(n, 5))
    (root / "sub/golden.PPTX").write_bytes(fixtures.golden())
    (root / "sub/cut.pptx").write_bytes(fixtures.golden()[:-9])
    (root / "empty.pptx").write_bytes(b"")
    (root / "other.txt").write_bytes(b"x")
    return root


def read(spark, folder, **options):
    ranged.register(spark)
    return spark.read.format(ranged.NAME).options(path=str(folder), **options).load()


def test_entries_as_zipfile_has_them(spark, folder):
    got = {(r.file, r.raw_name): r for r in read(spark, folder, content="all").where("zip_error IS NULL").collect()}
    want = {}
    for file in ("0.pptx", "3.pptx", "sub/golden.PPTX"):
        with zipfile.ZipFile(folder / file) as z:
            want |= {(file, i.filename): (i.file_size, i.compress_size, i.CRC, z.read(i)) for i in z.infolist()}
    assert want.items() <= {k: (r.usize, r.csize, r.crc, bytes(r.content)) for k, r in got.items()}.items()
    bad = {r.file for r in read(spark, folder).where("zip_error IS NOT NULL").collect()}
    assert bad == {"empty.pptx", "sub/cut.pptx"}


def test_files_have_hashes(spark, folder):
    got = {r.file: (r.size, r.source_sha256) for r in read(spark, folder, rows="files").collect()}
    import hashlib

    assert len(got) == 9 and all(v == (os.path.getsize(folder / f), hashlib.sha256((folder / f).read_bytes()).hexdigest()) for f, v in got.items())


def test_names_and_pushed_filters(spark, folder):
    assert {r.raw_name for r in read(spark, folder, names="ppt/slides/*.xml").collect()} == {"ppt/slides/slide1.xml"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read(spark, folder, pushdown="true").where((F.col("raw_name") == "ppt/slides/slide1.xml") & F.col("file").startswith("sub/") & (F.col("idx") > 2))
        assert [(r.file, r.raw_name) for r in rows.collect()] == [("sub/golden.PPTX", "ppt/slides/slide1.xml")]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def big(path, gib):
    """A package of so many GiB, of which nearly all is a hole in the file."""
    small = fixtures.package(text_shape(2, "A", (0, 0, 3000000, 1000000)))
    data = zipped(small)
    at = data.index(b"PK\x01\x02")
    hole = (gib << 30) - at - 100
    body, directory, end = data[:at], data[at:-22], data[-22:]
    raw = b"docProps/padding.bin"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 0, 0, 0, 0, 0, hole, hole, len(raw), 0) + raw
    directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 20, 20, 0, 0, 0, 0, 0, hole, hole, len(raw), 0, 0, 0, 0, 0, len(body)) + raw
    count, start = len(small) + 1, len(body) + len(local) + hole
    with open(path, "wb") as f:
        f.write(body + local)
        f.seek(start)
        f.write(directory + end[:8] + struct.pack("<HHIIH", count, count, len(directory), start, 0))
    return count


def test_three_gigabytes_are_listed_by_a_few_ranges(spark, tmp_path):
    count = big(tmp_path / "big.pptx", 3)
    with ranged.opened(str(tmp_path / "big.pptx")) as source:
        found = zip_entries.entries(source)
        assert len(found) == count and source.size > 3 << 30 and source.read_bytes < 1 << 20
        assert all(zip_entries.read(source, e)[1] is None for e in found if e.usize < 1 << 20) and source.read_bytes < 1 << 20
    rows = read(spark, tmp_path, split=str(1 << 30))
    assert rows.count() == count and rows.rdd.getNumPartitions() == 4


def test_members_of_one_package_are_spread(spark, tmp_path):
    extra = tuple((f"ppt/media/{i}.bin", os.urandom(50_000)) for i in range(40))
    data = zipped(package(extra=extra))
    (tmp_path / "wide.pptx").write_bytes(data)
    rows = read(spark, tmp_path, content="all", split="300000").withColumn("task", F.spark_partition_id())
    assert rows.where("content IS NOT NULL").select("task").distinct().count() >= 6
    assert sorted(r.raw_name for r in rows.collect()) == sorted(i.filename for i in zipfile.ZipFile(tmp_path / "wide.pptx").infolist())


def test_same_entries_from_ranges_and_from_memory(spark, folder, monkeypatch):
    def entries(files):
        return sorted(str(r) for r in decks.entries(files).select("input_key", "idx", "raw_name", "zip_error", "root", "rels", "slide_ids", F.size("shapes").alias("n")).collect())

    monkeypatch.setattr(decks, "SPLIT", 2000)
    files = decks.scan(spark, str(folder))
    held = spark.createDataFrame([(r.input_key, r.input_key, bytes((folder / r.file).read_bytes())) for r in files.collect()], "file string, input_key string, content binary")
    assert entries(files) == entries(held) and len(entries(files)) > 70


def test_equal_parts_are_parsed_once(spark, monkeypatch):
    monkeypatch.setattr(decks, "HOT", 20)  # so that parts that every package has are dealt over tasks
    n = 240
    files = decks.decks(spark.createDataFrame([(f"{i}.pptx", zipped(package(text_shape(2, f"S{i % 7}", (0, 0, 3000000, 1000000))))) for i in range(n)], "file string, content binary").repartition(4))
    seen = []
    monkeypatch.setattr(decks, "keep", lambda df, tag, keep=decks.keep: seen.append((tag, keep(df, tag))) or seen[-1][1])
    got = decks.entries(files)
    parsed, found = dict(seen)["part-store"].count(), dict(seen)["members"]
    assert parsed == found.select("digest").distinct().count() == 10 + 7
    rows = got.groupBy("root").count().collect()
    assert got.count() == n * 11 and {r.root: r["count"] for r in rows}["p:sld"] == n and {r.root: r["count"] for r in rows}["rel:Relationships"] == 5 * n
    assert got.where("root = 'p:sld' AND size(shapes) = 1").count() == n
