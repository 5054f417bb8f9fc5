"""What a file is by its first bytes. Never raises; only positive signatures count."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseweave.errors import ExtractionError
from caseweave.sources import ole

# Signatures at the start of a file, parts of office packages, and streams of compound files.
MAGIC = ((b"%PDF-", ".pdf"), (b"{\\rtf", ".rtf"), (b"\x89PNG\r\n\x1a\n", ".png"), (b"\xff\xd8\xff", ".jpg"), (b"II*\x00", ".tiff"), (b"MM\x00*", ".tiff"))
ZIP, OLE2 = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Entries of archives that are documents of a format without a reader here: OpenDocument, books, other packages.
DOCUMENT_MARKS = ("mimetype", "[Content_Types].xml")
OOXML = (("word/document.xml", ".docx"), ("xl/workbook.xml", ".xlsx"), ("ppt/presentation.xml", ".pptx"))
STREAMS = (("__substg1.0_", ".msg"), ("WordDocument", ".doc"), ("Workbook", ".xls"), ("PowerPoint Document", ".ppt"))


def is_bitmap(b: bytes) -> bool:
    """A bitmap header whose sizes agree with each other."""
    if len(b) < 30 or b[:2] != b"BM":
        return False
    size, _, offset, header = struct.unpack_from("<IIII", b, 2)
    return header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= max(size, offset) and struct.unpack_from("<H", b, 26)[0] == 1


def stream_names(content: bytes) -> list[str]:
    """Names in the directory of a compound file; of a damaged one, those where directory entries may be."""
    try:
        return [n.name for n in ole.Compound(content).nodes]
    except ExtractionError:
        out = []
        for at in range(512, min(len(content), 1 << 20) - ole.ENTRY + 1, ole.ENTRY):
            length, kind = struct.unpack_from("<HB", content, at + 64)
            if 2 < length <= 64 and kind in (ole.STORAGE, ole.STREAM) and content[at + length - 2 : at + length] == b"\0\0":
                out.append(content[at : at + length - 2].decode("utf-16-le", "replace"))
        return out


def sniff(content: bytes) -> str | None:
    """The suffix that the content identifies, or None."""
    for magic, suffix in MAGIC:
        if content.startswith(magic):
            return suffix
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return ".webp"
    if content.startswith(ZIP):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
        except Exception:  # a damaged or odd archive is still an archive; its reader says what is wrong
            return ".zip"
        return next((s for part, s in OOXML if part in names), None if any(m in names for m in DOCUMENT_MARKS) else ".zip")
    if content.startswith(OLE2):
        names = stream_names(content)
        return next((s for name, s in STREAMS if any(n.startswith(name) if name.endswith("_") else n == name for n in names)), None)
    return ".bmp" if is_bitmap(content) else None


def sniff_magic(content: Column) -> Column:
    """The signatures that need no second look, as a column expression over binary."""
    head, out = F.hex(F.substring(content, 1, 12)), F.lit(None).cast("string")
    out = F.when(head.startswith("52494646") & head.endswith("57454250"), ".webp").otherwise(out)
    out = F.when(head.startswith(ZIP.hex().upper()), ".zip").otherwise(out)
    for magic, suffix in reversed(MAGIC):
        out = F.when(head.startswith(magic.hex().upper()), suffix).otherwise(out)
    return out
