"""WARC archives: a writer with one gzip member a record, and a splittable reader.

Reader: a task has a byte range of an archive. It looks for gzip magic from the range's start, takes the first place where
a member decodes to a WARC header, and then follows record by record; it owns the records that start inside its range,
and reads the last of them past the range's end. So ranges can be cut anywhere and each record has one owner.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import materialize, new_dir
from foliograph.llm.exact_dedup import filter_of, repeated, tested

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: Bytes of a range, of a read, and of a false candidate's header that is looked through at most.
RANGE, READ, LOOKED = 8 << 20, 1 << 18, 1 << 22
#: Reading tasks at most; past that a task has several ranges.
TASKS = 100_000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH_HEADER = "X-Payload-Length"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# writing


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, bytes, refers_to: of equal payloads of LEAST_BYTES or more, the smallest key's is stored.

    Which payloads repeat is told from keys and digests. A Bloom filter of those that do lets pages of other payloads pass;
    the rest meet the smallest key by digest, those of very frequent payloads in a broadcast of fewer than 1000.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    keys = pages.select(F.col(key).cast("long").alias("page_id"), F.xxhash64(body).alias("_h"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    keys = materialize(keys.where(F.col("bytes") >= LEAST_BYTES).drop("bytes"), "payloads")
    often = repeated(keys, "_h")
    bits, slots = filter_of(often, "_h", often.count())
    groups = tested(keys, "_h", bits, slots).where("_maybe").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups, "groups")
    limit = -(-groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 1000)
    hot = F.broadcast(groups.where(F.col("n") > limit).drop("n"))  # fewer than 1000
    cold = groups.where(F.col("n") <= limit).drop("n")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("bytes"), F.xxhash64(body).alias("_h"))
    rows = tested(rows, "_h", bits, slots).withColumn("_maybe", F.col("_maybe") & (F.col("bytes") >= LEAST_BYTES))
    alone = rows.where("NOT _maybe").withColumn("first", F.lit(None).cast("long"))
    maybe = rows.where("_maybe").withColumn("digest", F.sha2("html", 256))
    common = maybe.join(hot, "digest")
    other = maybe.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest", "left")
    every = alone.unionByName(common.drop("digest")).unionByName(other.drop("digest"))
    return every.select("page_id", "url", F.col("html").cast("binary").alias("payload"), "bytes", F.sha2("html", 256).alias("digest"), F.when(F.col("first") != F.coalesce("page_id", F.lit(-(1 << 63))), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = HTTP % size
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}", f"{LENGTH_HEADER}: {size}"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes an archive for each partition into folder, which all executors must reach; returns path, bytes, records.

    A task writes under a name of its own attempt and renames at its end, so an attempt that dies leaves no half archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _opened(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.gz"
        draft, count, size = f"{base}/.{name}.{task.taskAttemptId()}", 0, 0
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    member = record(*[batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "bytes", "digest", "refers_to")])
                    out.write(member)
                    count, size = count + 1, size + len(member)
        store.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    rows = with_revisits(pages, key, url, html)
    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "archives")


# reading


class _Member:
    """The bytes that a gzip member at `at` of the file decodes to, a block at a time; `end` is where it ended."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        self.file, self.at, self.packed, self.end = file, at, zlib.decompressobj(31), None

    def blocks(self) -> Iterator[bytes]:
        tail = b""
        while not self.packed.eof:
            if not tail:
                self.file.seek(self.at)
                tail = self.file.read(READ)
                self.at += len(tail)
                if not tail:
                    raise zlib.error("the member is cut off")
            block = self.packed.decompress(tail, READ)
            tail = self.packed.unconsumed_tail
            if block:
                yield block
        self.end = self.at - len(self.packed.unused_data)


def _head(blocks: Iterator[bytes], start: bytes = b"") -> tuple[bytes, bytes]:
    """What comes before the first empty line, and what was read after it. Only the head of a WARC record may be long."""
    got, looked = bytearray(start), 0
    while (end := got.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
        looked = len(got)
        if looked > LOOKED and not got.startswith(b"WARC/"):
            raise ValueError("no header")
        got += next(blocks)
    return bytes(got[:end]), bytes(got[end + 4 :])


def read_record(file: pa.NativeFile, at: int) -> tuple[dict[str, str], int, str, int]:
    """Headers, payload bytes, payload digest and the end of the record at that place. The payload is never held whole."""
    member = _Member(file, at)
    blocks = member.blocks()
    head, rest = _head(blocks)
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    left = int(headers["content-length"])
    if headers.get("content-type", "").startswith("application/http"):
        http, body = _head(blocks, rest)
        left, rest = left - len(http) - 4, body
    digest, size = hashlib.sha256(), 0
    while True:
        part = rest[: left - size]
        digest.update(part)
        size += len(part)
        try:
            rest = next(blocks)
        except StopIteration:
            break
    if size != left:
        raise ValueError("a record is shorter than its length")
    return headers, size, digest.hexdigest(), member.end


def _is_record(file: pa.NativeFile, at: int) -> bool:
    try:
        head, _ = _head(_Member(file, at).blocks())
    except (zlib.error, StopIteration, ValueError):
        return False
    return head.startswith(b"WARC/1.") and b"\ncontent-length:" in head.lower()


def _next_record(file: pa.NativeFile, at: int, stop: int) -> int | None:
    """The first place from `at` and before `stop` where a record starts."""
    while at < stop:
        file.seek(at)
        window = file.read(min(READ, stop - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        while found >= 0:
            if at + found < stop and _is_record(file, at + found):
                return at + found
            found = window.find(MAGIC, found + 1)
        at += READ
    return None


def records_in(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], int, str]]:
    """Offset, headers, payload bytes and digest of each record that starts in [start, stop)."""
    at = _next_record(file, start, stop)
    while at is not None and at < stop:
        headers, size, digest, end = read_record(file, at)
        yield at, headers, size, digest
        file.seek(end)
        at = end if file.read(len(MAGIC)) == MAGIC else _next_record(file, end, stop)


def read(archives: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """One row per record of archives (path, bytes): path, offset, headers (lower-case names), payload_bytes, payload_digest."""
    ranges = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"), (F.lit(range_bytes)).alias("width"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "headers", "payload_bytes", "payload_digest"]
        kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string())
        for batch in batches:
            for path, start, width in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, place = _opened(path)
                rows: list[tuple] = []
                with store.open_input_file(place) as file:
                    for at, headers, size, digest in records_in(file, start, start + width):
                        rows.append((path, at, list(headers.items()), size, digest))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    dealt = ranges.repartition(min(int(tasks), TASKS))  # a number, or small rows would be brought together
    return dealt.mapInArrow(run, "path string, offset long, headers map<string,string>, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages as archives, reads them back; page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    Null html is an empty payload, a null url is left out of the record, a null key can't be referred to. Rows that repeat
    key and payload are all responses. Payloads and urls of any length are whole; a payload is never held whole when read.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    archives = write(pages, new_dir(pages.sparkSession, "warc"), key, url, html)
    header = lambda name: F.try_element_at("headers", F.lit(name))
    page = lambda name: F.regexp_extract(header(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    revisit = header("warc-type") == "revisit"
    return read(archives).select(
        page("warc-record-id").alias("page_id"),
        F.when(revisit, header(LENGTH_HEADER.lower()).cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract(header("warc-payload-digest"), "^sha256:(.*)$", 1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        header("warc-type").alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )
