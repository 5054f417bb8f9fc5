"""Secret scan: three base patterns, and runs of high entropy.

Base kinds are regular expressions, matched leftmost and without overlap for
each kind; matches that are too short are dropped after matching. The method
adds ``entropy`` spans: candidate strings of one character class are scanned by
a sliding window whose symbol counts, and with them its Shannon entropy, change
by one step in and one out. Windows at or above the class's threshold merge to
spans, if they hold a digit or letters that no word has in a row. What is on the
allow-list (identifiers and placeholders that look random but guard nothing) is
cut out of a candidate; windows beside it count as ever.

Defined cases: null and empty texts have no spans; texts are scanned whole;
offsets count code points, the end exclusive; repeated rows give equal rows.
"""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.arrow import text_udf

# The base patterns, with the letters of keywords in either case.
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

#: Character classes of candidates: characters, window, entropy in bits a symbol. A window of n
#: symbols has at most log2(n) bits (and log2 of the class's size); prose in Latin letters stays below 3.5 at these lengths.
CLASSES = (("0123456789abcdef", 32, 3.2), ("0123456789ABCDEF", 32, 3.2), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0))
#: What guards nothing: UUIDs, placeholders, paths of lower-case words; and runs of symbols in their order, of so many.
ALLOW = (
    r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])",
    r"(?i:example|placeholder|your[-_]?(?:api[-_]?)?key|changeme|x{4,}|lorem)",
    r"/?(?:[a-z]{3,}[/_-]){2,}[a-z]*",
)
IN_ORDER = 8
#: Letters other than vowels in a row that words do not have.
HARD = 6
EVIDENCE = re.compile(rf"[0-9]|(?=([b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{{{HARD}}}))")


def entropy_spans(run: str, window: int, least: float, evidence: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``run`` whose entropy is at least ``least`` bits.

    With ``evidence``, spans in order of their ends, a window counts only if it holds one whole.
    """
    n = len(run)
    if n < window:
        return []
    clog = [0.0, 0.0] + [c * log2(c) for c in range(2, window + 2)]  # one symbol comes before one goes
    counts: dict[str, int] = {}
    total = 0.0
    top = window * (log2(window) - least) + 1e-9  # entropy >= least  <=>  sum of c log c <= top
    out: list[list[int]] = []
    known, latest = 0, 0 if evidence is None else -1
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += clog[c + 1] - clog[c]
        counts[ch] = c + 1
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += clog[c - 1] - clog[c]
            counts[old] = c - 1
        if evidence is None:
            latest = i
        else:
            while known < len(evidence) and evidence[known][1] <= i + 1:
                latest = max(latest, evidence[known][0])
                known += 1
        start = i - window + 1
        if start >= 0 and total <= top and latest >= start:
            if out and start <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([start, i + 1])
    return [(a, b) for a, b in out]


def evidence_in(run: str) -> list[tuple[int, int]]:
    """Where a run has a digit, or HARD letters in a row that are no vowels."""
    return [(m.start(), m.start() + (HARD if m[1] else 1)) for m in EVIDENCE.finditer(run)]


def in_order(run: str) -> list[tuple[int, int]]:
    """Stretches of IN_ORDER symbols or more that each follow, or each precede, the one before."""
    out, at = [], 0
    while at + 1 < len(run):
        step, to = ord(run[at + 1]) - ord(run[at]), at + 1
        while to + 1 < len(run) and ord(run[to + 1]) - ord(run[to]) == step:
            to += 1
        if step in (1, -1) and to + 1 - at >= IN_ORDER:
            out.append((at, to + 1))
        at = to
    return out


def not_allowed(run: str, allow: re.Pattern) -> list[tuple[int, int]]:
    """What is left of a run without what guards nothing, as [start, end)."""
    out, at = [], 0
    for a, b in sorted([m.span() for m in allow.finditer(run)] + in_order(run)):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, len(run))] if at < len(run) else out


def scanner():
    """A function from a text to its spans (kind number, start, end), in order."""
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    access, hexa = re.compile(ACCESS), re.compile(f"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}")
    allow = re.compile("|".join(ALLOW))
    classes = []
    for symbols, window, least in CLASSES:
        inside = "".join(re.escape(c) for c in symbols)
        classes.append((re.compile(f"(?<![{inside}])[{inside}]{{{window},}}"), window, least))

    def scan(text: str) -> list[tuple[int, int, int]]:
        spans = [(0, m.start(), m.end()) for m in assign.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
        spans += [(1, m.start(), m.end()) for m in access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        spans += [(2, m.start(), m.end()) for m in hexa.finditer(text)]
        found = set()
        for pattern, window, least in classes:
            for m in pattern.finditer(text):
                for a, b in not_allowed(m.group(), allow):
                    part, at = m.group()[a:b], m.start() + a
                    if len(part) >= window and not part.isdigit():
                        found |= {(3, at + x, at + y) for x, y in entropy_spans(part, window, least, evidence_in(part))}
        return sorted([*spans, *found], key=lambda s: (s[1], s[0], s[2]))

    return scan


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of a text column, by start and then kind."""

    @text_udf(T.ArrayType(SPAN))
    def spans(texts: pa.Array) -> pa.Array:
        scan = scanner()
        offsets, kind, start, end = [0], [], [], []
        for value in texts.cast(pa.binary()):
            for k, a, b in scan((value.as_py() or b"").decode("utf-8", "replace")):
                kind.append(KINDS[k])
                start.append(a)
                end.append(b)
            offsets.append(len(kind))
        values = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return spans(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets): every row with its spans."""
    return docs.select(F.col(id_col), secret_spans(F.col(text_col)).alias("secrets"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; null texts stay null."""

    @text_udf(T.StringType())
    def clean(texts: pa.Array) -> pa.Array:
        scan, out = scanner(), []
        for value in texts:
            text = value.as_py()
            parts, at = [], 0
            for _, a, b in scan(text or ""):
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append(None if text is None else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base kinds, the SHA-256 of the base spans, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
