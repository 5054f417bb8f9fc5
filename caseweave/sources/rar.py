"""RAR archives by their headers: what they hold, and why they can't be opened.

Nothing here unpacks compressed entries. Headers are walked before anything
else, so that encryption, a set of volumes or a cut-off file is named as the
reason; entries that are stored without compression are delivered.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from caseweave.errors import ExtractionError

# Signatures, and header types and flags of both formats.
RAR3, RAR5 = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"
MAIN3, FILE3, END3 = 0x73, 0x74, 0x7B
MAIN5, FILE5, CRYPT5, END5 = 1, 2, 4, 5
ENTRIES_MOST = 1_000_000


@dataclass
class Entry:
    name: str
    size: int
    start: int
    packed: int
    stored: bool
    directory: bool
    encrypted: bool
    crc: int | None

    def data(self, archive: bytes) -> bytes | None:
        """The bytes of a stored entry whose checksum is right, else None."""
        raw = archive[self.start : self.start + self.packed]
        return raw if self.stored and not self.encrypted and len(raw) == self.size and self.crc in (None, zlib.crc32(raw)) else None


def survey(name: str, data: bytes) -> list[Entry]:
    """The entries of an archive; one that can't be opened raises ExtractionError with the reason."""
    at = data.find(RAR5, 0, 1 << 20)
    if at >= 0:
        return list(walk5(name, data, at + len(RAR5)))
    at = data.find(RAR3, 0, 1 << 20)
    if at >= 0:
        return list(walk3(name, data, at + len(RAR3)))
    raise ExtractionError(f"{name} is not a RAR archive")


def walk3(name: str, data: bytes, at: int):
    n, entries = len(data), 0
    while at + 7 <= n:
        kind, flags, size = struct.unpack_from("<BHH", data, at + 2)
        if size < 7 or at + size > n:
            raise ExtractionError(f"{name} is cut off")
        packed = struct.unpack_from("<I", data, at + 7)[0] if flags & 0x8000 and size >= 11 else 0
        if kind == MAIN3 and flags & 0x80:
            raise ExtractionError(f"{name} is encrypted with its names")
        if kind == MAIN3 and flags & 0x01:
            raise ExtractionError(f"{name} is one volume of a set")
        if kind == END3:
            return
        if kind == FILE3:
            if size < 32:
                raise ExtractionError(f"{name} is damaged")
            low, unpacked, crc, method, length = struct.unpack_from("<IIxI5xBH", data, at + 7)
            high = struct.unpack_from("<II", data, at + 32) if flags & 0x100 else (0, 0)
            start = at + 32 + (8 if flags & 0x100 else 0)
            raw = data[start : start + length].split(b"\0")[0]
            packed = low | high[0] << 32
            if at + size + packed > n:
                raise ExtractionError(f"{name} is cut off")
            entries += 1
            yield Entry(raw.decode("utf-8", "replace").replace("\\", "/"), unpacked | high[1] << 32, at + size, packed, method == 0x30, flags & 0xE0 == 0xE0, bool(flags & 0x04), crc)
        at += size + packed
        if entries > ENTRIES_MOST:
            raise ExtractionError(f"{name} lists more than {ENTRIES_MOST} entries")
    raise ExtractionError(f"{name} is cut off")


def vint(data: bytes, at: int, end: int) -> tuple[int, int]:
    out = shift = 0
    while at < end and shift < 70:
        out |= (data[at] & 0x7F) << shift
        at += 1
        if not data[at - 1] & 0x80:
            return out, at
        shift += 7
    raise ExtractionError("the archive is cut off")


def walk5(name: str, data: bytes, at: int):
    n, entries = len(data), 0
    while at + 7 <= n:
        size, pos = vint(data, at + 4, n)
        end = pos + size
        if not size or end > n:
            raise ExtractionError(f"{name} is cut off")
        if zlib.crc32(data[at + 4 : end]) != struct.unpack_from("<I", data, at)[0]:
            raise ExtractionError(f"{name} is damaged")
        kind, pos = vint(data, pos, end)
        flags, pos = vint(data, pos, end)
        extra = packed = 0
        if flags & 1:
            extra, pos = vint(data, pos, end)
        if flags & 2:
            packed, pos = vint(data, pos, end)
        if kind == CRYPT5:
            raise ExtractionError(f"{name} is encrypted with its names")
        if kind == MAIN5 and vint(data, pos, end)[0] & 1:
            raise ExtractionError(f"{name} is one volume of a set")
        if kind == END5:
            return
        if end + packed > n:
            raise ExtractionError(f"{name} is cut off")
        if kind == FILE5:
            own, pos = vint(data, pos, end)
            unpacked, pos = vint(data, pos, end)
            _, pos = vint(data, pos, end)
            pos += 4 if own & 2 else 0
            crc = None
            if own & 4:
                crc = struct.unpack_from("<I", data, pos)[0]
                pos += 4
            method, pos = vint(data, pos, end)
            _, pos = vint(data, pos, end)
            length, pos = vint(data, pos, end)
            encrypted = any(t == 1 for t in extras(data, end - extra, end))
            entries += 1
            yield Entry(data[pos : pos + length].decode("utf-8", "replace"), unpacked, end, packed, not method >> 7 & 7, bool(own & 1), encrypted, crc)
        at = end + packed
        if entries > ENTRIES_MOST:
            raise ExtractionError(f"{name} lists more than {ENTRIES_MOST} entries")
    raise ExtractionError(f"{name} is cut off")


def extras(data: bytes, at: int, end: int):
    """The types of the records in an extra area."""
    while at < end:
        size, at = vint(data, at, end)
        yield vint(data, at, end)[0]
        at += size
