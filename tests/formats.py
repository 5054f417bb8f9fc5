"""Small files of many formats, made here."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def zipped(entries: dict, method=zipfile.ZIP_STORED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("The Harbour", "Title") + p("Cargo", "Heading2") + p("one vessel &amp; its crew") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("")
    return zipped({"[Content_Types].xml": "<x/>", "word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})


def pptx() -> bytes:
    a, p, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shape = lambda text, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda *shapes: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:sld>'
    rel = "http://schemas.openxmlformats.org/package/2006/relationships"
    return zipped({
        "[Content_Types].xml": "<x/>",
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{rel}"><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide(shape("second shown")), "ppt/slides/slide2.xml": slide(shape("First", "title"), shape("shown before")),
    })


def xlsx() -> bytes:
    s, r, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    return zipped({
        "[Content_Types].xml": "<x/>",
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Crew" r:id="r1"/><sheet name="None" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{rel}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si><si><r><t>Ada </t></r><r><t>L</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>age</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>36</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{s}"><sheetData/></worksheet>',
    })


def pdf(pages: list[str], packed: bool = False, encrypted: bool = False) -> bytes:
    """A PDF of the pages' lines; the last page's font maps its codes to Unicode; ``packed`` puts objects into an object stream."""
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 >>"}
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0100> <0410> endbfrange 1 beginbfchar <0200> <0020> endbfchar"
    objects[4] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"
    streams = {5: cmap}
    kids = []
    for i, text in enumerate(pages):
        n = 10 + 2 * i
        kids.append(f"{n} 0 R")
        wide = i == len(pages) - 1 and not text.isascii()
        show = "".join(f"<{''.join('0200' if c == ' ' else f'{ord(c) - 0x40F:04x}' for c in line)}> Tj T* " if wide else f"[({line.replace('(', chr(92) + '(').replace(')', chr(92) + ')')[:3]}) 20 ({line.replace('(', chr(92) + '(').replace(')', chr(92) + ')')[3:]})] TJ T* " for line in text.split("\n"))
        streams[n + 1] = f"BT /F{1 if wide else 0} 12 Tf 72 700 Td {show} ET".encode()
        objects[n] = f"<< /Type /Page /Parent 2 0 R /Contents {n + 1} 0 R /Resources << /Font << /F0 3 0 R /F1 4 0 R >> >> >>".encode()
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(pages)} >>".encode()
    out = b"%PDF-1.5\n"
    if packed:
        body, heads = b"", []
        for n, o in objects.items():
            heads.append(f"{n} {len(body)}")
            body += o + b" "
        head = (" ".join(heads) + " ").encode()
        data = zlib.compress(head + body)
        out += f"90 0 obj\n<< /Type /ObjStm /N {len(objects)} /First {len(head)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    else:
        out += b"".join(f"{n} 0 obj\n".encode() + o + b"\nendobj\n" for n, o in objects.items())
    for n, body in streams.items():
        data = zlib.compress(body)
        out += f"{n} 0 obj\n<< /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R " + (b"/Encrypt 9 0 R " if encrypted else b"") + b">>\n%%EOF"


def compound(tree: dict) -> bytes:
    """A compound file; values are bytes, or dicts for storages."""
    nodes: list[list] = [["Root Entry", 5, FREE, None, b""]]

    def add(entries: dict) -> int:
        first, before = FREE, None
        for name, value in entries.items():
            at = len(nodes)
            nodes.append([name, 1 if isinstance(value, dict) else 2, FREE, None, b"" if isinstance(value, dict) else value])
            if before is None:
                first = at
            else:
                nodes[before][2] = at
            before = at
            nodes[at][3] = add(value) if isinstance(value, dict) else FREE
        return first

    nodes[0][3] = add(tree)
    mini, mini_table, big, starts = b"", [], [], {}
    for i, (_, kind, _, _, data) in enumerate(nodes):
        if kind == 2 and len(data) < 4096:
            starts[i] = len(mini) // 64 if data else END
            blocks = -(-len(data) // 64)
            mini_table += [len(mini_table) + k + 1 for k in range(blocks - 1)] + ([END] if blocks else [])
            mini += data.ljust(64 * blocks, b"\0")
        elif kind == 2:
            big.append(i)
    sectors, table = [], []

    def put(data: bytes) -> int:
        if not data:
            return END
        first, count = len(sectors), -(-len(data) // 512)
        for k in range(count):
            sectors.append(data[512 * k : 512 * k + 512].ljust(512, b"\0"))
            table.append(first + k + 1 if k + 1 < count else END)
        return first

    for i in big:
        starts[i] = put(nodes[i][4])
    root_start = put(mini)
    mini_start = put(struct.pack(f"<{len(mini_table)}I", *mini_table)) if mini_table else END
    raw = b""
    for i, (name, kind, right, child, data) in enumerate(nodes):
        coded = name.encode("utf-16-le") + b"\0\0"
        size, start = (len(mini), root_start) if i == 0 else (len(data), starts.get(i, 0))
        raw += coded.ljust(64, b"\0") + struct.pack("<HBBIII", len(coded), kind, 1, FREE, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    directory = put(raw)
    table_at = len(sectors)
    table.append(0xFFFFFFFD)
    sectors.append(struct.pack("<128I", *(table + [FREE] * (128 - len(table)))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, 1, directory, 0, 4096, mini_start, 1, END, 0, table_at)
    return head + struct.pack("<108I", *([FREE] * 108)) + b"".join(sectors)


def msg() -> bytes:
    text = lambda s: s.encode("utf-16-le")
    sent = struct.pack("<IIQ", 0x00390040, 0, 133_500_000_000_000_000)
    return compound({
        "__properties_version1.0": bytes(32) + sent, "__substg1.0_0037001F": text("Cargo"), "__substg1.0_1000001F": text("the vessel sails\r\non Friday"), "__substg1.0_0C1A001F": text("Ada"), "__substg1.0_5D01001F": text("ada@ports.example"),
        "__substg1.0_0E04001F": text("Bob"), "__attach_version1.0_#00000000": {"__substg1.0_37010102": b"goods " * 900, "__substg1.0_3707001F": text("manifest.txt")}, "__attach_version1.0_#00000001": {"__substg1.0_37010102": b"short", "__substg1.0_3704001E": b"B.TXT"},
    })


def vint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def rar5(entries: list[tuple[str, bytes, int]], volume: bool = False, encrypted: bool = False, end: bool = True) -> bytes:
    """(name, data, method) of each entry."""
    block = lambda body, data=b"": struct.pack("<I", zlib.crc32(vint(len(body)) + body)) + vint(len(body)) + body + data
    out = b"Rar!\x1a\x07\x01\x00"
    if encrypted:
        return out + block(vint(4) + vint(0) + b"\0\0")
    out += block(vint(1) + vint(0) + vint(1 if volume else 0))
    for name, data, method in entries:
        body = vint(2) + vint(2) + vint(len(data)) + vint(4) + vint(len(data)) + vint(0) + struct.pack("<I", zlib.crc32(data)) + vint(method << 7) + vint(0) + vint(len(name.encode())) + name.encode()
        out += block(body, data)
    return out + (block(vint(5) + vint(0) + vint(0)) if end else b"")


def rar3(entries: list[tuple[str, bytes, int]], flags: int = 0) -> bytes:
    out = b"Rar!\x1a\x07\x00" + struct.pack("<HBHH", 0, 0x73, flags, 13) + bytes(6)
    for name, data, method in entries:
        coded = name.encode()
        head = struct.pack("<BHH", 0x74, 0x8000, 32 + len(coded)) + struct.pack("<IIBIIBBHI", len(data), len(data), 0, zlib.crc32(data), 0, 20, method, len(coded), 0) + coded
        out += b"\0\0" + head + data
    return out + struct.pack("<HBHH", 0, 0x7B, 0, 7)
