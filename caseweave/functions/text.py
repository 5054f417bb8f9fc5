"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, where Java's \\s knows ASCII only.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

#: Latin letters with diacritics, and the letters without. Cyrillic stays as it is.
_FOLDED = [(c, base) for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c == c.lower() and (base := unicodedata.normalize("NFD", c)[0]) != c and base.isascii()]
ACCENTED, PLAIN = "".join(c for c, _ in _FOLDED), "".join(b for _, b in _FOLDED)
FOLDING = str.maketrans(ACCENTED, PLAIN)

#: Where a text came from, as a reader states it; anything else is unrecorded.
TEXT_SOURCES = ("text-layer", "ocr", "vlm", "native")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(lstrip(c), f"[{SPACE}]+$", "")


def one_line(c: Column, limit: int) -> Column:
    """White space collapsed, and cut with an ellipsis beyond ``limit`` characters."""
    flat = strip(F.regexp_replace(c, f"[{SPACE}]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def slugify(c: Column) -> Column:
    """Lower-case ASCII letters and digits, runs of all else as one hyphen, at most 64 characters."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 64), "-+$", "")


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 8)


def read_as(c: Column) -> Column:
    return F.when(c.isin(*TEXT_SOURCES), c).otherwise("unrecorded")


def join_location(root: Column, path: Column) -> Column:
    """A path under a root, without doubled separators and ``.`` steps; an absolute path replaces the root."""
    joined = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", root, path))
    steps = F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != "."))
    return F.concat(F.when(joined.startswith("/"), "/").otherwise(""), F.array_join(steps, "/"))


#: A token, and what can't stand beside one.
TOKEN = r"[\p{L}\p{N}]+"
_VARIANTS: dict[str, str] = {}
for _c, _b in _FOLDED:
    _VARIANTS[_b] = _VARIANTS.get(_b, "") + _c


def fold(c: Column) -> Column:
    """Lower case, Latin letters without their diacritics. The engine translates slowly, so only where there is something to fold."""
    low = F.lower(c)
    return F.when(low.rlike("[\u00c0-\u024f]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def raw_tokens(c: Column) -> Column:
    """Runs of letters and digits, as written; folding changes neither their number nor their ends."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded; what the keyword leg counts."""
    return F.transform(raw_tokens(c), fold)


def token_pattern(term: str) -> str:
    """A pattern for the tokens of a lower-cased text that fold to ``term``."""
    letters = "".join(f"[{c}{_VARIANTS[c]}]" if c in _VARIANTS else c for c in term)
    return rf"(?<![\p{{L}}\p{{N}}]){letters}(?![\p{{L}}\p{{N}}])"


def content_words(c: Column, stop: list[str]) -> Column:
    return F.array_except(tokens(c), F.array(*map(F.lit, stop)))


def stable_id(*parts: Column) -> Column:
    """32 hexadecimal digits from the parts; the same on every run."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32)
