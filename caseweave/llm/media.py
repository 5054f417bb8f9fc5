"""Media columns: what bytes are, whatever they are declared to be, and what they carry.

One pass of an Aho-Corasick automaton over a value locates the magic bytes of
all formats, and the end marks that some of them need. A validator of the
format then walks the structure from each hit and returns its exact length, or
rejects it. A value that is valid from its first byte has that type, whatever
was declared; every valid item at another place is embedded media, and can be
carved out. Items inside a valid item of a leaf format are not looked for twice.

Defined cases: null or empty bytes have no type and no items; truncated or
damaged media are rejected, not repaired; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.arrow import text_udf

# Magic bytes of the formats, and end marks.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"OggS": "application/ogg",
    b"II*\0": "image/tiff",
    b"MM\0*": "image/tiff",
    b"ftyp": "video/mp4",
    b"\x1a\x45\xdf\xa3": "video/x-matroska",
    b"fLaC": "audio/flac",
    b"ID3": "audio/mpeg",
    b"\xff\xfb": "audio/mpeg",
    b"\xff\xfa": "audio/mpeg",
    b"\xff\xf3": "audio/mpeg",
    b"\xff\xf2": "audio/mpeg",
}
#: Bytes before the magic ones.
LEAD = {"video/mp4": 4}
END_MARKS = {b"%%EOF": "pdf end", b"PK\x05\x06": "zip end"}
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
TIFF_SIZES = dict(enumerate((1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8), 1))
BOXES = frozenset(b"ftyp moov mdat free skip moof mfra sidx styp uuid wide meta pdin emsg".split())
BRANDS = {b"M4A ": "audio/mp4", b"M4B ": "audio/mp4", b"qt  ": "video/quicktime", b"heic": "image/heif", b"mif1": "image/heif", b"avif": "image/avif"}
MP3_RATES = ((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
MP3_SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000)}
#: Frames that make a stream of frames without a tag a sound.
MP3_FRAMES = 3

ITEM = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
SNIFFED = T.StructType([T.StructField("type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("items", T.ArrayType(ITEM))])


# --- validators: (bytes, start, end marks) -> (type, length), or None ----------------------------


def png(b, at, _):
    pos, n, data = at + 8, len(b), False
    while pos + 12 <= n:
        (length,), kind = struct.unpack_from(">I", b, pos), bytes(b[pos + 4 : pos + 8])
        if (pos == at + 8) != (kind == b"IHDR") or pos + 12 + length > n or zlib.crc32(b[pos + 4 : pos + 8 + length]) != struct.unpack_from(">I", b, pos + 8 + length)[0]:
            return None
        data |= kind == b"IDAT"
        pos += 12 + length
        if kind == b"IEND":
            return ("image/png", pos - at) if data and length == 0 else None
    return None


def jpeg(b, at, _):
    pos, n, frame = at + 2, len(b), False
    while pos + 4 <= n and b[pos] == 0xFF:
        marker = b[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        if marker == 0xD9:
            return ("image/jpeg", pos + 2 - at) if frame else None
        length = struct.unpack_from(">H", b, pos + 2)[0]
        if not 0xC0 <= marker <= 0xFE or length < 2:
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        pos += 2 + length
        if marker == 0xDA:  # entropy-coded data run up to a marker that is neither stuffed nor a restart
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < n and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0 or pos + 1 >= n:
                return None
            if b[pos + 1] == 0xD9:
                return ("image/jpeg", pos + 2 - at) if frame else None
    return None


def gif(b, at, _):
    n = len(b)
    if at + 13 > n:
        return None
    flags, pos, images = b[at + 10], at + 13, 0
    pos += 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(pos):
        while pos < n and b[pos]:
            pos += b[pos] + 1
        return pos + 1

    while pos < n:
        if b[pos] == 0x3B:
            return ("image/gif", pos + 1 - at) if images else None
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 11 < n:
            local = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            images += 1
        else:
            return None
    return None


def bmp(b, at, _):
    if at + 30 > len(b):
        return None
    size, _, offset, header, width, _, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    good = header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0
    return ("image/bmp", size) if good and 14 + header <= offset <= size <= len(b) - at else None


def riff(b, at, _):
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I", b, at + 4)[0], bytes(b[at + 8 : at + 12])
    if form not in RIFF_FORMS or size < 4 or at + 8 + size > len(b):
        return None
    chunks = {k: (pos, length) for k, pos, length in riff_chunks(b, at, at + 8 + size)}
    if not chunks or None in chunks or form == b"WAVE" and not sound_agrees(b, chunks):
        return None
    return RIFF_FORMS[form], 8 + size


def sound_agrees(b, chunks) -> bool:
    """Whether the format of a sound agrees with itself and its data are whole frames."""
    if not {b"fmt ", b"data"} <= chunks.keys() or chunks[b"fmt "][1] < 16:
        return False
    kind, channels, rate, per_second, frame, bits = struct.unpack_from("<HHIIHH", b, chunks[b"fmt "][0])
    if not channels or not rate or not frame or chunks[b"data"][1] % frame:
        return False
    return kind not in (1, 3) or frame == channels * -(-bits // 8) and per_second == rate * frame


def riff_chunks(b, at, end):
    """(kind, start, length) of the chunks; a last kind of None says that they overrun."""
    pos = at + 12
    while pos + 8 <= end:
        length = struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + length > end:
            yield None, pos, 0
            return
        yield bytes(b[pos : pos + 4]), pos + 8, length
        pos += 8 + length + length % 2
    if pos < end:
        yield None, pos, 0


def pdf(b, at, ends):
    """From the header to the end of the last end mark before the next header."""
    if at + 8 > len(b) or not (48 <= b[at + 5] <= 57 and b[at + 6] == 46):
        return None
    stops, heads = ends["pdf end"], ends["application/pdf"]
    i = bisect_right(heads, at)
    before = heads[i] if i < len(heads) else len(b)
    j = bisect_left(stops, before)
    return ("application/pdf", stops[j - 1] + 5 - at) if j and stops[j - 1] > at else None


def zip_starts(b, stops):
    """Where the archive of each end record begins, as its sizes say: the records by that."""
    out = {}
    for pos in stops:
        if pos + 22 <= len(b):
            size, offset = struct.unpack_from("<II", b, pos + 12)
            out.setdefault(pos - size - offset, []).append(pos)
    return out


def zipped(b, at, ends):
    """The first end record that says it begins here, with the right mark where its directory is."""
    for pos in ends["zip start"].get(at, ()):
        offset, note = struct.unpack_from("<IH", b, pos + 16)
        if b[at + offset : at + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            return "application/zip", min(pos + 22 + note, len(b)) - at
    return None


def gzipped(b, at, _):
    """Unpacks the member, however long, a piece at a time; its own checksum and length confirm it."""
    work, pos = zlib.decompressobj(31), at
    try:
        while not work.eof and pos < len(b):
            step = bytes(b[pos : pos + 65536])
            work.decompress(step, 1 << 20)
            while work.unconsumed_tail and not work.eof:
                work.decompress(work.unconsumed_tail, 1 << 20)
            pos += len(step)
    except zlib.error:
        return None
    return ("application/gzip", pos - len(work.unused_data) - at) if work.eof else None


def ogg(b, at, _):
    """Pages one after another, from a first one to the end of the stream."""
    pos, n, first = at, len(b), True
    while pos + 27 <= n and b[pos : pos + 5] == b"OggS\0":
        kind, count = b[pos + 5], b[pos + 26]
        if first != bool(kind & 2) or pos + 27 + count > n:
            return None
        pos += 27 + count + sum(b[pos + 27 : pos + 27 + count])
        first = False
        if kind & 4:
            return ("application/ogg", pos - at) if pos <= n else None
    return None


def tiff(b, at, _):
    """Directories one after another; the image ends where the last of what they name ends."""
    n, order, end, seen = len(b) - at, "<" if b[at : at + 1] == b"I" else ">", 8, set()
    if n < 8:
        return None
    (where,) = struct.unpack_from(order + "I", b, at + 4)
    while where:
        if where in seen or where < 8 or where + 6 > n:
            return None
        seen.add(where)
        (count,) = struct.unpack_from(order + "H", b, at + where)
        if not count or where + 6 + 12 * count > n:
            return None
        tags, values = [], {}
        for pos in range(at + where + 2, at + where + 2 + 12 * count, 12):
            tag, kind, many = struct.unpack_from(order + "HHI", b, pos)
            size = TIFF_SIZES.get(kind, 0) * many
            start = pos + 8 if size <= 4 else at + struct.unpack_from(order + "I", b, pos + 8)[0]
            if not size or start - at + size > n:
                return None
            end = max(end, start - at + size)
            tags.append(tag)
            if tag in (256, 257, 273, 279, 324, 325) and kind in (3, 4):
                values[tag] = struct.unpack_from(f"{order}{many}{'H' if kind == 3 else 'I'}", b, start)
        offsets, counts = (values.get(x) or values.get(y) or () for x, y in ((273, 324), (279, 325)))
        if tags != sorted(tags) or not {256, 257} <= values.keys() or not offsets or len(offsets) != len(counts) or any(o + c > n for o, c in zip(offsets, counts, strict=True)):
            return None
        end = max(end, where + 6 + 12 * count, *(o + c for o, c in zip(offsets, counts, strict=True)))
        (where,) = struct.unpack_from(order + "I", b, at + where + 2 + 12 * count)
    return ("image/tiff", end) if seen else None


def mp4(b, at, _):
    """Boxes one after another, as far as they are known ones; one describes the media, one holds them."""
    pos, n, kinds = at, len(b), []
    while pos + 8 <= n and (kind := bytes(b[pos + 4 : pos + 8])) in BOXES:
        size, head = struct.unpack_from(">I", b, pos)[0], 8
        if size == 1 and pos + 16 <= n:
            size, head = struct.unpack_from(">Q", b, pos + 8)[0], 16
        size = size or n - pos
        if size < head or pos + size > n:
            return None
        kinds.append(kind)
        pos += size
    if kinds[:1] != [b"ftyp"] or pos - at < 12 or b"mdat" not in kinds or not {b"moov", b"moof", b"meta"} & set(kinds):
        return None
    return BRANDS.get(bytes(b[at + 8 : at + 12]), "video/mp4"), pos - at


def vint(b, pos, end, keep):
    """(number of variable length, where it ends); with ``keep`` its length stays part of it. None where it overruns or has no end."""
    if pos >= end or not b[pos]:
        return None
    n = 9 - b[pos].bit_length()
    if pos + n > end:
        return None
    value = int.from_bytes(b[pos : pos + n], "big")
    if keep:
        return value, pos + n
    value &= (1 << 7 * n) - 1
    return None if value == (1 << 7 * n) - 1 else (value, pos + n)


def elements(b, pos, end):
    """(id, start, end) of the elements that fill a stretch; a last id of None says that they don't."""
    while pos < end:
        name = vint(b, pos, end, True)
        size = name and vint(b, name[1], end, False)
        if not size or size[1] + size[0] > end:
            yield None, pos, pos
            return
        yield name[0], size[1], size[1] + size[0]
        pos = size[1] + size[0]


def matroska(b, at, _):
    """A header that names the kind, then a segment of known size that its elements fill."""
    head = next(elements(b, at, len(b)), (None, 0, 0))
    kind = {i: bytes(b[x:y]).rstrip(b"\0") for i, x, y in elements(b, head[1], head[2])} if head[0] else {None: b""}
    if None in kind or kind.get(0x4282) not in (b"webm", b"matroska"):
        return None
    name, start, end = next(elements(b, head[2], len(b)), (None, 0, 0))
    if name != 0x18538067 or start == end or any(i is None for i, _, _ in elements(b, start, end)):
        return None
    return "video/webm" if kind[0x4282] == b"webm" else "video/x-matroska", end - at


def mp3_frame(b, pos):
    """Bytes of the frame of layer 3 that begins here, or None."""
    if pos + 4 > len(b) or b[pos] != 0xFF or b[pos + 1] & 0xE6 != 0xE2:
        return None
    version, rate, sampling = b[pos + 1] >> 3 & 3, b[pos + 2] >> 4, b[pos + 2] >> 2 & 3
    if version not in MP3_SAMPLING or rate in (0, 15) or sampling == 3:
        return None
    full = version == 3
    return (144 if full else 72) * 1000 * MP3_RATES[0 if full else 1][rate] // MP3_SAMPLING[version][sampling] + (b[pos + 2] >> 1 & 1)


def mp3(b, at, _):
    """A tag, if there is one, and frames one after another, the last of them whole."""
    pos, frames, tagged = at, 0, b[at : at + 3] == b"ID3"
    if tagged:
        if at + 10 > len(b) or any(x & 0x80 for x in b[at + 6 : at + 10]):
            return None
        pos += 10 + sum(x << 7 * (3 - i) for i, x in enumerate(b[at + 6 : at + 10]))
    while size := mp3_frame(b, pos):
        if pos + size > len(b):
            return None
        pos, frames = pos + size, frames + 1
    return ("audio/mpeg", pos - at) if frames >= (1 if tagged else MP3_FRAMES) else None


def crc_table(bits: int, polynomial: int) -> list[int]:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return out


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def flac_frame(b, pos):
    """(samples, bytes of the header) of the frame that begins here, if the header's checksum is right."""
    if pos + 6 > len(b) or b[pos] != 0xFF or b[pos + 1] & 0xFE != 0xF8:
        return None
    size, rate, channels, depth = b[pos + 2] >> 4, b[pos + 2] & 15, b[pos + 3] >> 4, b[pos + 3] >> 1 & 7
    if not size or rate == 15 or channels > 10 or depth == 3 or b[pos + 3] & 1:
        return None
    ones = 8 - (b[pos + 4] ^ 0xFF).bit_length()
    at = pos + 4 + max(1, ones)
    more = (1 if size == 6 else 2 if size == 7 else 0)
    end = at + more + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if ones == 1 or ones == 8 or end >= len(b):
        return None
    crc = 0
    for x in b[pos:end]:
        crc = CRC8[crc ^ x]
    if crc != b[end]:
        return None
    samples = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8 if size > 7 else int.from_bytes(b[at : at + more], "big") + 1
    return samples, end + 1 - pos


def flac(b, at, _):
    """Blocks of metadata, of which the first tells the samples, then frames until there are so many; the last ends by its checksum."""
    pos, n, last, total, least = at + 4, len(b), False, 0, 0
    while not last:
        if pos + 4 > n:
            return None
        last, kind, length = b[pos] >> 7, b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if (pos == at + 4) != (kind == 0) or kind == 0 and length != 34 or pos + 4 + length > n:
            return None
        if kind == 0:
            least, total = int.from_bytes(b[pos + 8 : pos + 11], "big"), int.from_bytes(b[pos + 14 : pos + 22], "big") & (1 << 36) - 1
        pos += 4 + length
    if not total:
        return None
    while frame := flac_frame(b, pos):
        samples, head = frame
        total -= samples
        if total <= 0:
            crc = 0
            for end in range(pos, n):
                crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ b[end]]
                if not crc and end + 1 - pos >= max(least, head + 3):
                    return "audio/flac", end + 1 - at
            return None
        pos += head + 2
        while (pos := b.find(b"\xff", pos)) >= 0 and not flac_frame(b, pos):
            pos += 1
        if pos < 0:
            return None
    return None


VALIDATE = {
    "image/png": png, "image/jpeg": jpeg, "image/gif": gif, "image/bmp": bmp, "riff": riff, "application/pdf": pdf, "application/zip": zipped, "application/gzip": gzipped, "application/ogg": ogg,
    "image/tiff": tiff, "video/mp4": mp4, "video/x-matroska": matroska, "audio/mpeg": mp3, "audio/flac": flac,
}


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for magic, name in (MAGIC | END_MARKS).items():
        out.add_word(magic.decode("latin-1"), (name, len(magic)))
    out.make_automaton()
    return out


def sniff(value: bytes, machine) -> list[tuple[str, int, int]]:
    """(type, start, length) of every valid item of the bytes, none inside another."""
    at = {"pdf end": [], "zip end": [], "application/pdf": []}
    hits = []
    for last, (name, n) in machine.iter(value.decode("latin-1")):
        if name in at:
            at[name].append(last - n + 1)
        if name in VALIDATE:
            hits.append((last - n + 1 - LEAD.get(name, 0), name))
    at["zip start"] = zip_starts(value, at["zip end"])
    out, free = [], 0
    for start, name in sorted(hits):
        if start >= free and (found := VALIDATE[name](value, start, at)):
            out.append((found[0], start, found[1]))
            free = start + found[1]
    return out


def sniff_media(value: Column, declared: Column) -> Column:
    """struct(type, corrected, items) of a binary column beside its declared type.

    ``type`` is that of the item at byte zero, else null; ``corrected`` says
    that it is known and differs from what was declared.
    """

    @text_udf(SNIFFED)
    def run(values: pa.Array, names: pa.Array) -> pa.Array:
        machine = automaton()
        offsets, kinds, starts, lengths, types, corrected = [0], [], [], [], [], []
        for v, d in zip(values, names, strict=True):
            found = sniff(v.as_py() or b"", machine)
            own = next((k for k, s, _ in found if s == 0), None)
            types.append(own)
            corrected.append(own is not None and own != d.as_py())
            for k, s, n in found:
                kinds.append(k)
                starts.append(s)
                lengths.append(n)
            offsets.append(len(kinds))
        items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["type", "start", "length"]))
        return pa.StructArray.from_arrays([pa.array(types, pa.string()), pa.array(corrected, pa.bool_()), items], names=["type", "corrected", "items"])

    return run(value, declared)


def correct_types(media: DataFrame, bytes_col: str = "media", type_col: str = "media_type") -> DataFrame:
    """``media`` with a column ``sniffed``; its declared types stay beside it."""
    return media.withColumn("sniffed", sniff_media(F.col(bytes_col), F.col(type_col)))


def carve(sniffed: DataFrame, id_col: str, bytes_col: str = "media") -> DataFrame:
    """(id, type, start, data): the bytes of every embedded item, one in a row."""
    return (
        sniffed.select(F.col(id_col), F.col(bytes_col).alias("carve_bytes"), F.explode(F.filter("sniffed.items", lambda i: i["start"] > 0)).alias("item"))
        .select(id_col, "item.type", "item.start", F.substring("carve_bytes", F.col("item.start").cast("int") + 1, F.col("item.length").cast("int")).alias("data"))
    )


# --- the digest of op6: text stored as 8-bit sound, and read back --------------------------------

BLOCK, RATE = 64, 8000
DIGEST = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_bytes", "payload_bytes")]
    + [T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


def pad(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def store_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples, a sample for each byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def read_wav(value: bytes, start: int, length: int) -> bytes:
    return next(bytes(value[s : s + n]) for k, s, n in riff_chunks(value, start, start + length) if k == b"data")


def features(sniffed: list[tuple[str, int, int]], samples: bytes, declared: str, inner: list[tuple[str, int, int]]) -> str:
    """Declared and true type, length of the sound, mean level of its samples, and media embedded in them."""
    import numpy as np

    level = np.frombuffer(samples, np.uint8)
    carved = ",".join(f"{k}@{s}+{n}" for k, s, n in inner) or "-"
    return f"{declared}>{sniffed[0][0]};samples={len(level)};sum={int(level.sum(dtype=np.int64))};silent={int((level == 0).sum())};embedded={carved}"


def text_media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Each text stored as WAV under a wrong declared type, sniffed, read back and digested.

    The sniffer has to find the sound, confirm its chunks and lengths and so
    correct the type; what is read back are the samples of the item that it
    found, and embedded media are looked for in them.
    """

    @text_udf(DIGEST)
    def run(texts: pa.Array) -> pa.Array:
        machine, rows = automaton(), []
        for value in texts.cast(pa.binary()):
            text = value.as_py() or b""
            stored = store_wav(pad(text))
            found = sniff(stored, machine)
            back = read_wav(stored, *found[0][1:])
            rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), features(found, back, declared, sniff(back, machine))))
        return pa.StructArray.from_arrays([pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, DIGEST, strict=True)], names=DIGEST.names)

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("d")).select(id_col, "d.*")
