"""Text of modern office files, which are archives of XML: documents, slides, workbooks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from caseweave.errors import ExtractionError

# Namespaces of the parts.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Bytes that one part may unpack to.
PART_MOST = 256 << 20


class Package:
    """The parts of an office file; what is damaged raises ExtractionError."""

    def __init__(self, name: str, data: bytes) -> None:
        self.name = name
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(data))
            self.names = set(self.archive.namelist())
        except Exception as e:
            raise ExtractionError(f"could not read {name}: {e}") from e

    def xml(self, part: str) -> ElementTree.Element:
        try:
            with self.archive.open(part) as f:
                raw = f.read(PART_MOST + 1)
            if len(raw) > PART_MOST or b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
                raise ExtractionError(f"{self.name}: {part} is too large or declares entities")
            return ElementTree.fromstring(raw)
        except ExtractionError:
            raise
        except Exception as e:
            raise ExtractionError(f"could not read {part} of {self.name}: {e}") from e

    def targets(self, part: str) -> dict[str, str]:
        """Parts that a part refers to, by the id it uses."""
        folder, leaf = posixpath.split(part)
        rels = f"{folder}/_rels/{leaf}.rels" if folder else f"_rels/{leaf}.rels"
        if rels not in self.names:
            return {}
        return {r.get("Id", ""): posixpath.normpath(posixpath.join("/", folder, r.get("Target", ""))).lstrip("/") for r in self.xml(rels).iter(f"{REL}Relationship") if r.get("TargetMode") != "External"}


def flat(text: str) -> str:
    return " ".join(text.split())


def paragraph(node: ElementTree.Element) -> str:
    out = []
    for n in node.iter():
        if n.tag == f"{W}t":
            out.append(n.text or "")
        elif n.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            out.append(" " if n.tag == f"{W}tab" else "\n")
    return "".join(out).strip()


def heading(node: ElementTree.Element) -> int:
    """The level of a paragraph that is a heading, else 0."""
    style = node.find(f"{W}pPr/{W}pStyle")
    named = style.get(f"{W}val", "") if style is not None else ""
    if named.lower() == "title":
        return 1
    found = re.fullmatch(r"(?i)heading\s?([1-6])", named)
    return int(found[1]) if found else 0


def blocks(body: ElementTree.Element) -> Iterator[str]:
    for node in body:
        if node.tag == f"{W}p":
            text, level = paragraph(node), heading(node)
            if text:
                yield f"{'#' * level} {flat(text)}" if level else text
        elif node.tag == f"{W}tbl":
            rows = (" | ".join(flat(" ".join(paragraph(p) for p in cell.iter(f"{W}p"))) for cell in row.iter(f"{W}tc")) for row in node.iter(f"{W}tr"))
            yield "\n".join(r for r in rows if r.strip(" |"))
        elif node.tag == f"{W}sdt":
            for inner in node.iter(f"{W}sdtContent"):
                yield from blocks(inner)


def document_text(name: str, data: bytes) -> str:
    """Paragraphs with Markdown headings, and tables as rows, a blank line between blocks."""
    body = Package(name, data).xml("word/document.xml").find(f"{W}body")
    return "\n\n".join(filter(None, blocks(body))) if body is not None else ""


def slides_text(name: str, data: bytes) -> tuple[str, int]:
    """(slides in their order, each under its title; how many)."""
    package = Package(name, data)
    show, targets = package.xml("ppt/presentation.xml"), package.targets("ppt/presentation.xml")
    parts = [targets.get(s.get(f"{R}id", ""), "") for s in show.iter(f"{P}sldId")]
    out = []
    for i, part in enumerate((p for p in parts if p in package.names), 1):
        title, lines = "", []
        for shape in package.xml(part).iter(f"{P}sp"):
            kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            said = [flat("".join(t.text or "" for t in p.iter(f"{A}t"))) for p in shape.iter(f"{A}p")]
            if kind is not None and kind.get("type") in ("title", "ctrTitle") and not title:
                title = flat(" ".join(said))
            else:
                lines += said
        for row in package.xml(part).iter(f"{A}tr"):
            lines.append(" | ".join(flat("".join(t.text or "" for t in cell.iter(f"{A}t"))) for cell in row.iter(f"{A}tc")))
        out.append("\n\n".join([f"# {title or f'slide {i}'}", *filter(None, lines)]))
    return "\n\n".join(out), len(out)


def workbook_rows(name: str, data: bytes) -> Iterator[tuple[str, list[tuple[int, list[str]]]]]:
    """(title, rows as (number, cells)) of every sheet; what formulas last gave, not what they say."""
    package = Package(name, data)
    book, targets = package.xml("xl/workbook.xml"), package.targets("xl/workbook.xml")
    shared = []
    if "xl/sharedStrings.xml" in package.names:
        shared = ["".join(t.text or "" for t in item.iter(f"{S}t")) for item in package.xml("xl/sharedStrings.xml").iter(f"{S}si")]
    for sheet in book.iter(f"{S}sheet"):
        part = targets.get(sheet.get(f"{R}id", ""), "")
        if part not in package.names:
            continue
        rows = []
        for i, row in enumerate(package.xml(part).iter(f"{S}row"), 1):
            cells: list[str] = []
            for cell in row.iter(f"{S}c"):
                at = column_of(cell.get("r", "")) if cell.get("r") else len(cells)
                if at > 16384:
                    continue
                cells += [""] * (at + 1 - len(cells))
                cells[at] = cell_text(cell, shared)
            rows.append((int(row.get("r") or i), cells))
        yield sheet.get("name", ""), rows


def column_of(reference: str) -> int:
    out = 0
    for c in re.match("[A-Z]*", reference)[0]:
        out = 26 * out + ord(c) - 64
    return max(0, out - 1)


def cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t", "n"), cell.findtext(f"{S}v") or ""
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    return {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value
