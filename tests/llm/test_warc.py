import gzip
import hashlib
import zlib

import pytest
from pyarrow import fs

from foliograph.llm import warc
from foliograph.llm.common import new_dir

BIG = "<html>" + "é" * 200
PAGES = [(1, "http://a/", BIG), (2, None, BIG), (3, "http://b/\r\nX: y ü", "short"), (4, "", "short"), (5, "u", None), (6, "u", ""), (7, "u", BIG + "x"), (None, "u", BIG + "x"), (8, "u", "z" * 3_000_000), (9, "u", BIG), (2, None, BIG)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], "page_id long, url string, html string, bytes long, digest string")


def test_round_trip(spark):
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark, PAGES)).collect())
    first = {}
    for i, _, h in PAGES:
        body = (h or "").encode()
        if i is not None:
            first[body] = min(i, first.get(body, i))
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        refers = first.get(body) if len(body) >= 100 and first.get(body) != i else None
        want.append((str(i), len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=lambda x: x)


def test_empty(spark):
    assert warc.round_trip(frame(spark, PAGES).where("false")).count() == 0


def members(n, size=300):
    out, places = b"", []
    for i in range(n):
        body = hashlib.sha256(str(i).encode()).hexdigest().encode() * (size // 64 + i % 7)
        places.append(len(out))
        out += warc.record(i, f"http://x/{i}", body, len(body), hashlib.sha256(body).hexdigest(), None)
    return out, places


@pytest.mark.parametrize("width", [1, 7, 100, 1000, 10**6])
def test_every_cut_has_one_owner(tmp_path, width):
    data, places = members(40)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        found = [r[0] for start in range(0, len(data), width) for r in warc.records_in(file, start, start + width)]
    assert found == places


def test_false_magic(tmp_path):
    """Magic in stored bytes, and junk between records, are no records."""
    body = warc.MAGIC * 50 + gzip.compress(b"no warc") + b"\x1f\x8b"
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    member = packer.compress(raw) + packer.flush()
    data = b"junk" + warc.MAGIC + member + b"\0" * 9 + member
    path = tmp_path / "b.warc.gz"
    path.write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        whole = list(warc.records_in(file, 0, len(data)))
        assert [r[0] for r in whole] == [7, 7 + len(member) + 9]
        assert [r[2:] for r in whole] == [(len(body), hashlib.sha256(body).hexdigest())] * 2
        assert [r[0] for s in range(0, len(data), 64) for r in warc.records_in(file, s, s + 64)] == [r[0] for r in whole]


def test_cut_file(spark, tmp_path):
    data, _ = members(3)
    path = tmp_path / "c.warc.gz"
    path.write_bytes(data[:-5])
    with fs.LocalFileSystem().open_input_file(str(path)) as file, pytest.raises(zlib.error):
        list(warc.records_in(file, 0, len(data)))


def test_small_ranges_in_spark(spark):
    archives = warc.write(frame(spark, PAGES), new_dir(spark, "warc-test"))
    assert archives.agg({"records": "sum"}).first()[0] == len(PAGES)
    assert warc.read(archives, 64).count() == len(PAGES)


def test_a_task_for_each_range(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "sha2(cast(id AS string), 512) || sha2(cast(-id AS string), 512) AS html")
    archives = warc.write(pages.repartition(2), new_dir(spark, "warc-test"))
    ranges = archives.selectExpr("sum(ceil(bytes / 4096))").first()[0]
    tasks = {r[0] for r in warc.read(archives, 4096).selectExpr("spark_partition_id()").collect()}
    assert ranges > 16 and len(tasks) > ranges // 2


def test_long_url(spark):
    rows = [(1, "http://x/" + "u" * 2_000_000, BIG), (2, "http://x/" + "ü" * 700_000, BIG), (3, "y", "z")]
    got = warc.round_trip(frame(spark, rows)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]


def test_very_frequent_payload(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", f"CASE WHEN id % 3 = 0 THEN '{BIG}' ELSE repeat(cast(id div 2 AS string), 40) END AS html")
    got = {r.page_id: r.refers_to for r in warc.round_trip(pages).collect()}
    want = {}
    for i in range(3000):
        body = BIG if i % 3 == 0 else str(i // 2) * 40
        want.setdefault(body, []).append(i)
    firsts = {i: own[0] if i != own[0] and len(body.encode()) >= 100 else None for body, own in want.items() for i in own}
    assert got == firsts
