import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from caseweave.llm import media as M


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b" + bytes(9) + b"\xff\xda\x00\x04\x00\x00" + b"\x12\xff\x00\x34\xff\xd0\x55" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28)
PDF = b"%PDF-1.4\nbody %%EOF more\n%%EOF"
GZ = gzip.compress(b"hello" * 50)
OGG = b"OggS\0\x02" + bytes(20) + b"\x01\x03abc" + b"OggS\0\x04" + bytes(20) + b"\x00"
WAV = M.store_wav(bytes(range(64)))


def tiff(order):
    entries = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 8), (270, 2, 9, 100), (273, 4, 1, 80), (279, 4, 1, 4)]
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, len(entries))
    for tag, kind, many, value in entries:
        head += struct.pack(order + "HHI", tag, kind, many) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    head += bytes(4)
    assert len(head) <= 86
    return head.ljust(100, b"\7") + b"a remark\0"


def box(kind, data):
    return struct.pack(">I", 8 + len(data)) + kind + data


MP4 = box(b"ftyp", b"isom\0\0\0\1") + box(b"free", b"") + box(b"moov", b"inside") + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 20) + b"data"


def element(name, data):
    return bytes.fromhex(name) + bytes([0x40, len(data)]) + data


WEBM = element("1a45dfa3", element("4282", b"webm")) + element("18538067", element("1549a966", b"information") + element("ec", b""))
MP3 = b"".join(b"\xff\xfb\x90\x64" + bytes(413) for _ in range(4))
TAGGED = b"ID3\x03\0\0" + bytes([0, 0, 0, 20]) + bytes(20) + MP3[:834]


def crc(data, bits, polynomial):
    """Bit by bit."""
    out = 0
    for x in data:
        out ^= x << bits - 8
        for _ in range(8):
            out = (out << 1) ^ (polynomial if out >> bits - 1 & 1 else 0)
            out &= (1 << bits) - 1
    return out


def flac():
    out = b"fLaC" + b"\0\0\0\x22" + struct.pack(">HH", 192, 192) + bytes(6) + (44100 << 44 | 15 << 36 | 400).to_bytes(8, "big") + bytes(16) + b"\x84\0\0\x05" + b"notes"
    for i in range(3):
        head = b"\xff\xf8\x19\x08" + bytes([i])
        frame = head + bytes([crc(head, 8, 0x07)]) + b"\0" + struct.pack(">h", 77 * i)
        out += frame + struct.pack(">H", crc(frame, 16, 0x8005))
    return out


def make_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x" * 10)
        z.writestr("b.png", PNG)
    return out.getvalue()


ZIP = make_zip()
ALL = {"image/png": PNG, "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/gzip": GZ, "application/ogg": OGG, "audio/wav": WAV, "application/zip": ZIP}
ALL |= {"image/tiff": tiff("<"), "video/mp4": MP4, "video/webm": WEBM, "audio/mpeg": MP3, "audio/flac": flac()}


def test_every_format_alone_truncated_and_embedded():
    machine = M.automaton()
    for kind, data in ALL.items():
        assert M.sniff(data, machine) == [(kind, 0, len(data))], kind
        assert not any(s == 0 and k == kind for k, s, _ in M.sniff(data[:-1], machine)) or kind == "application/pdf"
        assert M.sniff(b"BM RIFF junk " + data + b" tail", machine) == [(kind, 13, len(data))], kind
    joined = b"".join(ALL.values())
    at, want = 0, []
    for kind, data in ALL.items():
        want.append((kind, at, len(data)))
        at += len(data)
    assert M.sniff(joined, machine) == want


def test_other_forms_and_damage():
    machine = M.automaton()
    only = lambda data: M.sniff(data, machine)
    assert only(tiff(">")) == [("image/tiff", 0, 109)] and only(TAGGED) == [("audio/mpeg", 0, len(TAGGED))] and only(MP3[:834]) == []
    assert only(MP4.replace(b"isom", b"M4A "))[0][0] == "audio/mp4" and only(MP4.replace(b"moov", b"mxxv")) == []
    assert only(WEBM.replace(b"webm", b"wxbm")) == [] and only(WEBM.replace(bytes.fromhex("18538067"), bytes.fromhex("18538068"))) == []
    broken = bytearray(flac())
    broken[-1] ^= 1
    assert only(bytes(broken)) == []
    # a sound whose rate, frames or data do not agree
    for at, value in ((28, 7), (32, 2), (22, 0)):
        wrong = bytearray(WAV)
        wrong[at] = value
        assert only(bytes(wrong)) == []


def test_an_archive_of_many_archives_and_a_long_member():
    machine, out = M.automaton(), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(40):
            z.writestr(f"{i}.zip", ZIP)
    data = out.getvalue()
    assert M.sniff(data, machine) == [("application/zip", 0, len(data))] and M.sniff(b"xy" + data, machine) == [("application/zip", 2, len(data))]
    long = gzip.compress(bytes(300 << 20), 9)
    assert M.sniff(long + b"more", machine) == [("application/gzip", 0, len(long))]


def test_corrects_and_carves(spark):
    rows = [(1, PNG, "image/jpeg"), (2, PNG, "image/png"), (3, b"x" + GIF + b"yy" + BMP, "text/plain"), (4, None, None), (5, b"", ""), (6, PNG[:20], "image/png"), (2, PNG, "image/png")]
    df = spark.createDataFrame(rows, "id long, media binary, media_type string").selectExpr("*", "1 as item", "2 as type")
    out = M.correct_types(df)
    got = sorted((r.id, r.sniffed.type, r.sniffed.corrected) for r in out.collect())
    assert got == [(1, "image/png", True), (2, "image/png", False), (2, "image/png", False), (3, None, False), (4, None, False), (5, None, False), (6, None, False)]
    assert sorted((r.id, r.type, r.start, bytes(r.data)) for r in M.carve(out, "id").collect()) == [(3, "image/bmp", 3 + len(GIF), BMP), (3, "image/gif", 1, GIF)]


def test_digest(spark):
    texts = [None, "", "é" * 32, "a" * 65, "b" * 200000, PDF.decode() + " x", "a" * 65]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as d", "2 as feature")
    for r in M.text_media_digest(df).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        wav = M.store_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert r.feature.startswith("application/octet-stream>audio/wav;")
        assert ("application/pdf@0" in r.feature) == (r.doc_id == 5)
    assert M.text_media_digest(df.limit(0)).count() == 0
