"""Enrichment: summaries before embedding, their recipe, and the ports of models."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT_CHARS = 20_000


class Summariser(Protocol):
    """Summaries of a document's passages, one for each in order, and of the document from notes on them."""

    name: str

    def passages(self, document: str, texts: list[str]) -> list[str]: ...

    def document(self, notes: str) -> str: ...


class Reranker(Protocol):
    name: str

    def scores(self, query: str, texts: list[str]) -> list[float]: ...


def fold_summary(summary: Column, text: Column) -> Column:
    """What is embedded: the summary above the text, or the text alone; stored texts stay as they are."""
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(summary, F.lit("\n\n"), text)).otherwise(text)


def fingerprint(*parts: Column) -> Column:
    """Twelve hexadecimal digits that name a recipe."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def numbered_notes(notes: list[str], most: int = DOCUMENT_CHARS) -> str:
    """Notes with their numbers, as many whole ones as fit."""
    out, size = [], 0
    for i, note in enumerate(notes, 1):
        line = f"{i}. {' '.join(note.split())}"
        if size + len(line) + 1 > most:
            break
        out.append(line)
        size += len(line) + 1
    return "\n".join(out)


def summarise(summariser: Summariser, document: str, texts: list[str]) -> tuple[list[str], str]:
    """(passage summaries, document summary); a summariser that leaves one out or empty is an error."""
    got = summariser.passages(document[:DOCUMENT_CHARS], texts)
    if len(got) != len(texts) or not all(s.strip() for s in got):
        raise ValueError(f"{summariser.name} gave {len(got)} summaries for {len(texts)} passages, or an empty one")
    return got, summariser.document(numbered_notes(got))
