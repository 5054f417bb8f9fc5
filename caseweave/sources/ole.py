"""Compound files (OLE2): their directory and streams, and Outlook messages in them."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from caseweave.errors import ExtractionError

# The signature, marks of the allocation table, and the size of a directory entry.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_REGULAR, FREE, ENTRY = 0xFFFFFFFA, 0xFFFFFFFF, 128
STORAGE, STREAM, ROOT = 1, 2, 5
#: Properties of a message, and of an attachment, by the number in their stream's name.
SUBJECT, BODY, SENDER, ADDRESS, SMTP, TO, CC, HTML = "0037", "1000", "0C1A", "0C1F", "5D01", "0E04", "0E03", "1013"
DATA, LONG_NAME, SHORT_NAME = "3701", "3707", "3704"
SENT = (0x00390040, 0x0E060040)


@dataclass
class Node:
    name: str
    kind: int
    left: int
    right: int
    child: int
    start: int
    size: int


class Compound:
    """A compound file; damaged ones raise ExtractionError."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 512 or not data.startswith(MAGIC):
            raise ExtractionError("not a compound file")
        self.data = data
        sector, mini = struct.unpack_from("<HH", data, 30)
        if sector not in (9, 12) or mini != 6:
            raise ExtractionError("a compound file of unknown sector size")
        self.sector, self.mini = 1 << sector, 1 << mini
        directory, = struct.unpack_from("<I", data, 48)
        self.cutoff, first_mini, _, next_table, tables = struct.unpack_from("<IIIII", data, 56)
        listed = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(tables, len(data) // self.sector)):
            block = struct.unpack(f"<{self.sector // 4}I", self._sector(next_table))
            listed += block[:-1]
            next_table = block[-1]
        self.table: list[int] = []
        for s in listed:
            if s < LAST_REGULAR:
                self.table += struct.unpack(f"<{self.sector // 4}I", self._sector(s))
        raw = self._chain(directory)
        self.nodes = [self._node(raw[i : i + ENTRY]) for i in range(0, len(raw) - ENTRY + 1, ENTRY)]
        if not self.nodes or self.nodes[0].kind != ROOT:
            raise ExtractionError("a compound file without a root")
        chain = self._chain(first_mini) if first_mini < LAST_REGULAR else b""
        self.mini_table = struct.unpack(f"<{len(chain) // 4}I", chain)
        self.mini_data = self._chain(self.nodes[0].start)[: self.nodes[0].size] if self.nodes[0].size else b""

    def _sector(self, s: int) -> bytes:
        out = self.data[(s + 1) * self.sector : (s + 2) * self.sector]
        if not out:
            raise ExtractionError("a compound file is cut off")
        return out.ljust(self.sector, b"\0")

    def _chain(self, s: int) -> bytes:
        out, seen = [], 0
        while s < LAST_REGULAR:
            seen += 1
            if s >= len(self.table) or seen > len(self.table):
                raise ExtractionError("a chain of a compound file is broken")
            out.append(self._sector(s))
            s = self.table[s]
        return b"".join(out)

    @staticmethod
    def _node(raw: bytes) -> Node:
        length, kind = struct.unpack_from("<HB", raw, 64)
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, size = struct.unpack_from("<IQ", raw, 116)
        return Node(raw[: max(0, min(64, length) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, size & 0xFFFFFFFF)

    def children(self, node: Node) -> list[Node]:
        """The entries directly below a storage, by name."""
        out, todo, seen = [], [node.child], set()
        while todo:
            i = todo.pop()
            if i < len(self.nodes) and i not in seen:
                seen.add(i)
                own = self.nodes[i]
                todo += [own.left, own.right]
                if own.kind in (STORAGE, STREAM):
                    out.append(own)
        return sorted(out, key=lambda n: n.name)

    def read(self, node: Node) -> bytes:
        if node.size >= self.cutoff:
            return self._chain(node.start)[: node.size]
        out, s, seen = [], node.start, 0
        while s < LAST_REGULAR:
            seen += 1
            if s >= len(self.mini_table) or seen > len(self.mini_table):
                raise ExtractionError("a chain of a compound file is broken")
            out.append(self.mini_data[s * self.mini : (s + 1) * self.mini])
            s = self.mini_table[s]
        return b"".join(out)[: node.size]


def properties(file: Compound, node: Node) -> dict[str, Node]:
    """Property streams of a message or attachment, by number; Unicode ones before others."""
    out: dict[str, Node] = {}
    for n in file.children(node):
        if n.kind == STREAM and n.name.startswith("__substg1.0_") and len(n.name) >= 20:
            number = n.name[12:16].upper()
            if number not in out or n.name.upper().endswith("001F"):
                out[number] = n
    return out


def text_of(file: Compound, node: Node | None) -> str:
    if node is None:
        return ""
    kind = "utf-16-le" if node.name.upper().endswith("001F") else "cp1252"
    return file.read(node).decode(kind, "replace").rstrip("\0")


def sent_at(file: Compound) -> str:
    """When a message was sent, from its fixed properties."""
    for n in file.children(file.nodes[0]):
        if n.name == "__properties_version1.0":
            raw = file.read(n)
            for at in range(32, len(raw) - 15, 16):
                tag, _, value = struct.unpack_from("<IIQ", raw, at)
                if tag in SENT and value:
                    return str(dt.datetime(1601, 1, 1) + dt.timedelta(microseconds=value // 10))
    return ""


def message(data: bytes) -> tuple[dict[str, str], str, str, int]:
    """(header fields, body, body as HTML if there is no other, number of attachments) of an Outlook message."""
    file = Compound(data)
    own = properties(file, file.nodes[0])
    get = lambda number: text_of(file, own.get(number))
    name, address = get(SENDER), get(SMTP) or get(ADDRESS)
    sender = f"{name} <{address}>" if name and address and name != address else name or address
    fields = {"From": sender, "To": get(TO), "Cc": get(CC), "Date": sent_at(file), "Subject": get(SUBJECT)}
    body, html = get(BODY), own.get(HTML)
    return fields, body, "" if body or html is None else file.read(html).decode("utf-8", "replace"), sum(1 for _ in attachments(data))


def attachments(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the attachments that are files; a message in a message has no bytes of its own."""
    file = Compound(data)
    for i, n in enumerate((n for n in file.children(file.nodes[0]) if n.kind == STORAGE and n.name.startswith("__attach")), 1):
        own = properties(file, n)
        if DATA in own and own[DATA].kind == STREAM and (raw := file.read(own[DATA])):
            yield text_of(file, own.get(LONG_NAME)) or text_of(file, own.get(SHORT_NAME)) or f"attachment-{i}", raw
