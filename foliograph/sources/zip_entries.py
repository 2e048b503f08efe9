"""Directory and members of an untrusted ZIP, in memory or read by ranges; nothing is inflated beyond its declared size."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from pyarrow import NativeFile

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class ZipError(ValueError):
    pass


@dataclass(frozen=True)
class Entry:
    idx: int
    raw: bytes
    name: str
    method: int
    flags: int
    crc: int
    csize: int
    usize: int
    offset: int


class Held:
    """Bytes in memory, read by range."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def at(self, start: int, count: int) -> bytes:
        return self.data[start : start + count]


class Ranged:
    """A seekable file (pyarrow's), of which only the ranges asked for are read: small ones by whole blocks, a few of which are held."""

    BLOCK, BLOCKS = 128 << 10, 8

    def __init__(self, file: NativeFile) -> None:
        self.file, self.size, self.read_bytes = file, file.size(), 0
        self.blocks: dict[int, bytes] = {}

    def _read(self, start: int, count: int) -> bytes:
        data = self.file.read_at(max(0, min(count, self.size - start)), start)
        self.read_bytes += len(data)
        return data

    def _block(self, n: int) -> bytes:
        held = self.blocks.pop(n, None)
        if held is None:
            held = self._read(n * self.BLOCK, self.BLOCK)
            if len(self.blocks) >= self.BLOCKS:
                del self.blocks[next(iter(self.blocks))]
        self.blocks[n] = held
        return held

    def at(self, start: int, count: int) -> bytes:
        if start >= self.size or count <= 0:
            return b""
        if count > self.BLOCK:
            return self._read(start, count)
        first, last = start // self.BLOCK, (start + count - 1) // self.BLOCK
        data = self._block(first) + (self._block(last) if last > first else b"")
        return data[start - first * self.BLOCK :][:count]


Bytes = Held | Ranged


def _end(data: Bytes) -> tuple[int, bytes]:
    """Where the last end record whose comment reaches the end of the data stands, and it."""
    for most in (22, 22 + MAX16):  # few archives have a comment
        low = max(0, data.size - most)
        tail = data.at(low, most)
        at = tail.rfind(END)
        while at >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                return low + at, tail[at : at + 22]
            at = tail.rfind(END, 0, at + len(END) - 1)
    raise ZipError("no end of the central directory")


def _directory(data: Bytes) -> tuple[int, int, int, int]:
    """Offset, size and entries of the central directory, and where its trailer starts."""
    end, record = _end(data)
    disk, first_disk, on_disk, count, size, offset = struct.unpack_from("<HHHHII", record, 4)
    if MAX16 not in (disk, first_disk, on_disk, count) and MAX32 not in (size, offset):
        if disk or first_disk or on_disk != count:
            raise ZipError("split archives are not supported")
        return offset, size, count, end
    locator = data.at(end - 20, 20) if end >= 20 else b""
    if locator[:4] != LOCATOR64:
        raise ZipError("no ZIP64 locator")
    locator_disk, at, disks = struct.unpack_from("<IQI", locator, 4)
    if locator_disk or disks != 1 or at + 56 > end - 20 or data.at(at, 4) != END64:
        raise ZipError("invalid ZIP64 locator")
    length, _, _, disk64, first64, on64, count64, size64, offset64 = struct.unpack("<QHHIIQQQQ", data.at(at + 4, 52))
    if at + 12 + length != end - 20 or disk64 or first64 or on64 != count64:
        raise ZipError("invalid ZIP64 record")
    for small, large, most in ((count, count64, MAX16), (on_disk, on64, MAX16), (size, size64, MAX32), (offset, offset64, MAX32), (disk, disk64, MAX16), (first_disk, first64, MAX16)):
        if small not in (most, large):
            raise ZipError("the ZIP64 record contradicts the end record")
    return offset64, size64, count64, at


def _sizes64(extra: bytes, usize: int, csize: int, offset: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            body, values = extra[at + 4 : at + 4 + length], []
            for v in (usize, csize, offset):
                if v == MAX32:
                    if len(body) < 8:
                        raise ZipError("a ZIP64 field is missing")
                    v, body = struct.unpack_from("<Q", body)[0], body[8:]
                values.append(v)
            return tuple(values)
        at += 4 + length
    return usize, csize, offset


def entries(data: bytes | Bytes) -> list[Entry]:
    """All central headers in their order, repeated names included; ZipError where the structure contradicts itself."""
    data = Held(data) if isinstance(data, bytes) else data
    offset, size, count, trailer = _directory(data)
    if offset + size != trailer:
        raise ZipError("the central directory's bounds don't meet its end record")
    found, at = [], offset
    while at < offset + size:
        head = data.at(at, 46)
        if at + 46 > offset + size or head[:4] != CENTRAL:
            raise ZipError("an unknown record stands in the central directory")
        flags, method, _, _, crc, csize, usize, n, m, k, _, _, _, local = struct.unpack_from("<HHHHIIIHHHHHII", head, 8)
        if at + 46 + n + m + k > offset + size:
            raise ZipError("a central header is cut off")
        raw, extra = data.at(at + 46, n), data.at(at + 46 + n, m)
        usize, csize, local = _sizes64(extra, usize, csize, local)
        found.append(Entry(len(found), raw, raw.decode("utf-8" if flags & 0x800 else "cp437", "replace"), method, flags, crc, csize, usize, local))
        at += 46 + n + m + k
    if len(found) != count:
        raise ZipError(f"the directory declares {count} entries and has {len(found)}")
    return found


def overlapping(found: list[Entry]) -> set[int]:
    """Numbers of the entries whose local records reach into another's; such members can't be trusted."""
    out: set[int] = set()
    furthest = None
    for e in sorted(found, key=lambda e: e.offset):
        if furthest and e.offset < furthest[0]:
            out |= {e.idx, furthest[1]}
        end = e.offset + 30 + len(e.raw) + e.csize
        if not furthest or end > furthest[0]:
            furthest = (end, e.idx)
    return out


def read(data: bytes | Bytes, entry: Entry) -> tuple[bytes | None, str | None]:
    """The member, or the code of what is wrong with it."""
    data = Held(data) if isinstance(data, bytes) else data
    head = data.at(entry.offset, 30)
    if len(head) < 30 or head[:4] != LOCAL:
        return None, "entry-read-failed"
    flags, method, _, _, crc, csize, usize, n, m = struct.unpack_from("<HHHHIIIHH", head, 6)
    later = flags & 8  # sizes follow the member
    if data.at(entry.offset + 30, n) != entry.raw or method != entry.method or flags & 1 or not later and crc != entry.crc:
        return None, "entry-read-failed"
    if not later and not (usize in (entry.usize, MAX32) and csize in (entry.csize, MAX32)):
        return None, "entry-read-failed"
    packed = data.at(entry.offset + 30 + n + m, entry.csize)
    if len(packed) < entry.csize:
        return None, "entry-read-failed"
    try:
        if entry.method == 0:
            body = packed
        elif entry.method == 8:
            stream = zlib.decompressobj(-15)
            body = stream.decompress(packed, entry.usize + 1)
        else:
            return None, "entry-read-failed"
    except zlib.error:
        return None, "entry-read-failed"
    if len(body) > entry.usize:
        return None, "actual-size-limit-exceeded"
    if len(body) < entry.usize:
        return None, "entry-size-mismatch"
    if zlib.crc32(body) != entry.crc:
        return None, "entry-read-failed"
    return body, None
