"""Cutting texts into overlapping passages that their offsets select exactly.

The window has ``size`` characters. If it is not the last and a paragraph break
ends in its second half, it ends with the last such break. The next window
begins ``overlap`` characters before that end, but steps back by no more than
half of what was taken. Passages are trimmed; blank windows have no ordinal.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

BREAK = re.compile(r"\n\s*\n")
#: What ends a line, and a heading: a line that begins with marks, white space around it aside.
LINE_ENDS = "\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
HEADING = re.compile(rf"(?<![^{LINE_ENDS}])[^\S{LINE_ENDS}]*(#{{1,6}})[^\S{LINE_ENDS}]+(\S[^{LINE_ENDS}]*)")
HEADING_CHARS, TRAIL_CHARS = 200, 512


class Outline:
    """The headings of a text: where each line begins, and the trail that holds from there."""

    def __init__(self, text: str) -> None:
        found = list(HEADING.finditer(text))
        self.starts = [m.start() for m in found]
        self.trails: list[str] = []
        names: list[str | None] = [None] * 6  # of the headings that hold, by depth
        for m in found:
            depth = len(m[1])
            names[depth - 1 :] = [m[2].strip()[:HEADING_CHARS]] + [None] * (6 - depth)
            self.trails.append(" > ".join(n for n in names if n is not None)[:TRAIL_CHARS])

    def before(self, position: int) -> str:
        """The trail of the last heading that begins before the line of ``position``."""
        i = bisect_left(self.starts, position)
        return self.trails[i - 1] if i else ""


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The [start, end) of every window, untrimmed."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            # a break counts if all of it lies in the second half of the window
            last = 0
            for found in BREAK.finditer(text, start + size // 2, end):
                last = found.end()
            end = last or end
        yield start, end
        if end >= n:
            return
        start = max(start + 1, end - min(overlap, (end - start) // 2))


def passages(text: str, size: int, overlap: int) -> list[tuple[int, str, int, int, str]]:
    """(ordinal, text, start, end, heading trail) of every passage."""
    if size < 1 or overlap >= size:
        raise ValueError("the window must be positive and larger than the overlap")
    out: list[tuple[int, str, int, int, str]] = []
    if not text or text.isspace():
        return out
    outline = Outline(text)
    line_ends = [m.start() for m in re.finditer("\n", text)] if outline.starts else []
    for start, end in windows(text, size, overlap):
        window = text[start:end]
        body = window.strip()
        if body:
            first = start + window.index(body[0]) if window[0].isspace() else start
            i = bisect_right(line_ends, start - 1)
            line = line_ends[i - 1] + 1 if i else 0
            out.append((len(out), body, first, first + len(body), outline.before(line)))
    return out
