"""Page images: their size by the header, bounded before anything decodes them."""

from __future__ import annotations

import struct

from caseweave.errors import ExtractionError

# Pixels that an image may declare, and media types.
PIXELS_MOST = 80_000_000
TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp", ".webp": "image/webp"}


def jpeg_size(b: bytes) -> tuple[int, int] | None:
    pos = 2
    while pos + 9 <= len(b) and b[pos] == 0xFF:
        marker = b[pos + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            high, wide = struct.unpack_from(">HH", b, pos + 5)
            return wide, high
        pos += 1 if marker == 0xFF else 2 if 0xD0 <= marker <= 0xD8 else 2 + struct.unpack_from(">H", b, pos + 2)[0]
    return None


def tiff_size(b: bytes) -> tuple[int, int] | None:
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", b, 4)[0]
    found = {}
    for i in range(struct.unpack_from(order + "H", b, at)[0]):
        tag, kind, _ = struct.unpack_from(order + "HHI", b, at + 2 + 12 * i)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), b, at + 10 + 12 * i)[0]
    return (found[256], found[257]) if len(found) == 2 else None


def webp_size(b: bytes) -> tuple[int, int] | None:
    kind = b[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if kind == b"VP8L" and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        wide, high = struct.unpack_from("<HH", b, 26)
        return wide & 0x3FFF, high & 0x3FFF
    return None


def size_of(b: bytes) -> tuple[int, int] | None:
    """(width, height) that an image's header declares."""
    try:
        if b.startswith(b"\x89PNG"):
            return struct.unpack_from(">II", b, 16)
        if b.startswith(b"\xff\xd8"):
            return jpeg_size(b)
        if b[:4] in (b"II*\0", b"MM\0*"):
            return tiff_size(b)
        if b.startswith(b"BM"):
            wide, high = struct.unpack_from("<ii", b, 18)
            return abs(wide), abs(high)
        return webp_size(b) if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else None
    except (struct.error, IndexError):
        return None


def check(name: str, b: bytes) -> tuple[int, int]:
    """The size of an image that may be decoded; else an ExtractionError."""
    size = size_of(b)
    if size is None:
        raise ExtractionError(f"could not read the image header of {name}")
    if size[0] * size[1] > PIXELS_MOST:
        raise ExtractionError(f"{name} declares {size[0]}x{size[1]} pixels, more than {PIXELS_MOST}")
    return size
