"""Tools for agents over a workspace: named functions that give payloads, with corpus text fenced."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import functions as F

from caseweave.errors import CaseweaveError
from caseweave.functions import windows as kernel
from caseweave.operators.pages import READ_MOST, clamped
from caseweave.surface import api
from caseweave.surface.payloads import NOTICE, citation, error_payload, fence
from caseweave.workspace import Workspace

LIMIT_MOST = 50


def case_get_passage(w: Workspace, casefile: str, chunk_id: str) -> dict:
    """A passage with the window around it."""
    p = w.passage(casefile, chunk_id)
    text = w.table("documents", p.casefile_id).filter(F.col("id") == p.document_id).first().extracted_text
    near = w.table("chunks", p.casefile_id).filter((F.col("document_id") == p.document_id) & F.col("ordinal").between(p.ordinal - kernel.RADIUS, p.ordinal + kernel.RADIUS)).select("ordinal", "char_start", "char_end", "heading_path").collect()
    hit = kernel.Hit(p.document_id, p.ordinal, p.char_start, p.char_end, p.heading_path, p.text, text, [tuple(r) for r in near])
    span, _ = kernel.window(hit, kernel.Sheet(text))
    nonce = secrets.token_hex(8)
    return {"chunk_id": p.chunk_id, "document_id": p.document_id, "matched_char_start": p.char_start, "matched_char_end": p.char_end, "char_start": (span or (p.char_start,))[0], "char_end": (span or (0, p.char_end))[1], "text": fence(text[slice(*span)] if span else p.text, nonce), "fence_nonce": nonce, "content_notice": NOTICE}


def case_read_document(w: Workspace, casefile: str, document: str, offset: int = 0, length: int = READ_MOST) -> dict:
    """A bounded slice of a document's text."""
    row, (offset, length) = w.document(casefile, document), clamped(offset, length, READ_MOST)
    text, nonce = row.extracted_text, secrets.token_hex(8)
    more = offset + length < len(text)
    return {"document_id": row.id, "text": fence(text[offset : offset + length], nonce), "characters": len(text), "truncated": more, "continue_from": offset + length if more else None, "fence_nonce": nonce, "content_notice": NOTICE}


def case_cite(w: Workspace, casefile: str, chunk_id: str) -> dict:
    """A citation that resolves to a document and a span, with the passage itself."""
    p = w.passage(casefile, chunk_id)
    here = w.table("documents").filter(F.col("id") == p.document_id)
    text = here.select(citation(F.col("containment_path"), F.lit(p.heading_path), F.lit(p.char_start), F.lit(p.char_end), F.lit(w.casefile(casefile).slug), F.col("id"))).first()[0]
    nonce = secrets.token_hex(8)
    return {"citation": text, "chunk_id": p.chunk_id, "document_id": p.document_id, "char_start": p.char_start, "char_end": p.char_end, "quote": fence(p.text, nonce), "fence_nonce": nonce, "content_notice": NOTICE}


def _as_tool(f: Callable, **fixed: str) -> Callable:
    return lambda w, **args: f(w, {k: str(v) for k, v in args.items()} | fixed)


TOOLS: dict[str, Callable[..., dict]] = {
    "case_list_casefiles": _as_tool(api.list_casefiles),
    "case_casefile_overview": _as_tool(api.show_casefile),
    "case_list_documents": _as_tool(api.list_documents),
    "case_list_passages": _as_tool(api.list_passages),
    "case_search": lambda w, **args: api.search(w, {k: str(v) for k, v in args.items()} | {"limit": str(max(1, min(int(args.get("limit", 10)), LIMIT_MOST)))}),
    "case_mention_documents": _as_tool(api.mention_documents),
    "case_mentions": _as_tool(api.mentions),
    "case_get_passage": case_get_passage,
    "case_read_document": case_read_document,
    "case_cite": case_cite,
}


def call(w: Workspace, name: str, allowed: frozenset[str] = frozenset(TOOLS), **args) -> dict:
    """Run a tool that the profile admits; its errors are payloads."""
    if name not in TOOLS or name not in allowed:
        return {"error": "NotFoundError", "message": f"no tool {name!r}", "status": 404}
    try:
        return TOOLS[name](w, **args)
    except CaseweaveError as e:
        return error_payload(e)
