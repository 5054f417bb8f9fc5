"""The web routes as one function from a request to a payload, and as a WSGI application."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import parse_qs

from caseweave.errors import CaseweaveError, ValidationError
from caseweave.operators.pages import page
from caseweave.surface.payloads import error_payload, page_payload, search_payload
from caseweave.workspace import Workspace

Args = dict[str, str]
ROUTES: list[tuple[str, re.Pattern[str], Callable]] = []


def route(method: str, path: str):
    pattern = re.compile(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path))

    def register(f: Callable) -> Callable:
        ROUTES.append((method, pattern, f))
        return f

    return register


def number(args: Args, name: str, default: int) -> int:
    try:
        return int(args.get(name, default))
    except ValueError as e:
        raise ValidationError(f"{name} must be a whole number") from e


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


@route("GET", "/health")
def health(w: Workspace, _: Args) -> dict:
    return {"status": "ok", "identity": w.contract.identity()}


@route("GET", "/api/casefiles")
def list_casefiles(w: Workspace, _: Args) -> dict:
    return {"casefiles": rows(w.casefiles())}


@route("POST", "/api/casefiles")
def create_casefile(w: Workspace, a: Args) -> dict:
    return w.create_casefile(a.get("title", ""), a.get("slug", ""), a.get("description", "")).asDict()


@route("GET", "/api/casefiles/{casefile}")
def show_casefile(w: Workspace, a: Args) -> dict:
    return w.casefile(a["casefile"]).asDict() | {"statistics": w.statistics(a["casefile"]).asDict(), "coverage": w.coverage(a["casefile"]).asDict()}


@route("PATCH", "/api/casefiles/{casefile}")
def update_casefile(w: Workspace, a: Args) -> dict:
    return w.update_casefile(a["casefile"], **{k: a[k] for k in ("title", "slug", "description") if k in a}).asDict()


@route("DELETE", "/api/casefiles/{casefile}")
def delete_casefile(w: Workspace, a: Args) -> dict:
    return w.delete_casefile(a["casefile"]).asDict()


@route("POST", "/api/casefiles/{casefile}/ingest")
def ingest(w: Workspace, a: Args) -> dict:
    return w.ingest(a["casefile"], a.get("path", "")).asDict()


@route("GET", "/api/casefiles/{casefile}/documents")
def list_documents(w: Workspace, a: Args) -> dict:
    return page_payload(w.documents_page(a["casefile"], a.get("parent"), a.get("expanded") == "true", number(a, "offset", 0), number(a, "limit", 50)), "documents")


@route("GET", "/api/casefiles/{casefile}/documents/{document}")
def show_document(w: Workspace, a: Args) -> dict:
    return w.document(a["casefile"], a["document"]).asDict() | {"chain": [r.id for r in w.containment_chain(a["casefile"], a["document"])], **w.location_record(a["casefile"], a["document"])}


@route("GET", "/api/casefiles/{casefile}/documents/{document}/passages")
def list_passages(w: Workspace, a: Args) -> dict:
    from pyspark.sql import functions as F

    document = w.document(a["casefile"], a["document"])
    mine = w.table("chunks").filter(F.col("document_id") == document.id).select("chunk_id", "document_id", "ordinal", "heading_path", "char_start", "char_end", F.length("text").alias("characters"))
    return page_payload(page(mine, [F.asc(c) for c in ("ordinal", "char_start", "chunk_id")], number(a, "offset", 0), number(a, "limit", 50)), "passages")


@route("GET", "/api/casefiles/{casefile}/search")
def search(w: Workspace, a: Args) -> dict:
    return search_payload(w.search(a["casefile"], a.get("q", ""), number(a, "limit", 10), a.get("mention", "")).orderBy("position").collect())


@route("GET", "/api/casefiles/{casefile}/mentions")
def mentions(w: Workspace, a: Args) -> dict:
    return {"mentions": rows(w.mentions(a["casefile"], a.get("kind", ""), number(a, "limit", 50)))}


@route("GET", "/api/casefiles/{casefile}/mentions/documents")
def mention_documents(w: Workspace, a: Args) -> dict:
    return page_payload(w.mention_documents(a["casefile"], a.get("mention", ""), number(a, "offset", 0), number(a, "limit", 50)), "documents")


def handle(w: Workspace, method: str, path: str, args: Args | None = None) -> tuple[int, dict]:
    """(status, payload) of a request; errors are payloads too."""
    for verb, pattern, f in ROUTES:
        if verb == method and (found := pattern.fullmatch(path)):
            try:
                return 200, f(w, (args or {}) | found.groupdict())
            except CaseweaveError as e:
                payload = error_payload(e)
                return payload["status"], payload
    return 404, {"error": "NotFoundError", "message": f"no route {method} {path}", "status": 404}


def application(w: Workspace):
    """A WSGI application over a workspace."""

    def app(environ, start):
        args = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()}
        size = int(environ.get("CONTENT_LENGTH") or 0)
        if size:
            args |= {k: str(v) for k, v in json.loads(environ["wsgi.input"].read(size)).items()}
        status, payload = handle(w, environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/"), args)
        start(f"{status} {'OK' if status == 200 else 'Error'}", [("Content-Type", "application/json; charset=utf-8")])
        return [json.dumps(payload, default=str, ensure_ascii=False).encode()]

    return app
