"""The command line over a workspace: ``python -m caseweave.surface.cli PATH COMMAND …``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caseweave.errors import CaseweaveError
from caseweave.operators import evaluate
from caseweave.surface.payloads import citation, error_payload, page_payload, search_payload
from caseweave.workspace import Workspace, open_workspace


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="caseweave")
    out.add_argument("path")
    out.add_argument("--config", default="", help="a file with contract and profile")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **options) -> None:
        p = commands.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        for o, default in options.items():
            p.add_argument(f"--{o}", default=default, type=type(default), **({} if not isinstance(default, bool) else {}))

    command("status")
    command("casefile-create", "title", slug="", description="")
    command("casefile-list")
    command("casefile-show", "casefile")
    command("casefile-update", "casefile", title="", slug="", description="")
    command("casefile-delete", "casefile")
    command("ingest", "casefile", "root")
    command("search", "casefile", "query", limit=10, mention="")
    command("mentions", "casefile", kind="", limit=50)
    command("mention-documents", "casefile", "mention", offset=0, limit=50)
    command("document-list", "casefile", parent="", expanded=0, offset=0, limit=50)
    command("document-show", "casefile", "document")
    command("document-delete", "casefile", "document")
    command("document-ids", "casefile")
    command("document-passages", "casefile", "document")
    command("evaluate", "casefile", "judgements", limit=10, record="", baseline="")
    command("vacuum", keep=8)
    command("cite", "casefile", "passage")
    command("repair-mention-offsets", "casefile")
    return out


def run(w: Workspace, a: argparse.Namespace) -> dict:
    rows = lambda df: [r.asDict() for r in df.collect()]
    match a.command:
        case "status":
            return {"identity": w.contract.identity(), "casefiles": w.casefiles().count()}
        case "casefile-create":
            return w.create_casefile(a.title, a.slug, a.description).asDict()
        case "casefile-list":
            return {"casefiles": rows(w.casefiles())}
        case "casefile-show":
            return w.casefile(a.casefile).asDict() | {"statistics": w.statistics(a.casefile).asDict(), "coverage": w.coverage(a.casefile).asDict()}
        case "casefile-update":
            return w.update_casefile(a.casefile, **{k: getattr(a, k) for k in ("title", "slug", "description") if getattr(a, k)}).asDict()
        case "casefile-delete":
            return w.delete_casefile(a.casefile).asDict()
        case "ingest":
            return w.ingest(a.casefile, a.root).asDict()
        case "search":
            return search_payload(w.search(a.casefile, a.query, a.limit, a.mention).orderBy("position").collect())
        case "mentions":
            return {"mentions": rows(w.mentions(a.casefile, a.kind, a.limit))}
        case "mention-documents":
            return page_payload(w.mention_documents(a.casefile, a.mention, a.offset, a.limit), "documents")
        case "document-list":
            return page_payload(w.documents_page(a.casefile, a.parent or None, bool(a.expanded), a.offset, a.limit), "documents")
        case "document-show":
            return w.document(a.casefile, a.document).asDict() | {"chain": [r.id for r in w.containment_chain(a.casefile, a.document)], **w.location_record(a.casefile, a.document)}
        case "document-delete":
            return w.delete_document(a.casefile, a.document).asDict()
        case "document-ids":
            return {"ids": [r.id for r in w.document_ids(a.casefile).collect()]}
        case "document-passages":
            return {"passages": rows(w.document_passages(a.casefile, a.document))}
        case "evaluate":
            return evaluated(w, a)
        case "vacuum":
            return {"deleted": w.vacuum(a.keep)}
        case "cite":
            p = w.passage(a.casefile, a.passage)
            here = w.table("documents").filter(F.col("id") == p.document_id)
            text = here.select(citation(F.col("containment_path"), F.lit(p.heading_path), F.lit(p.char_start), F.lit(p.char_end), F.lit(w.casefile(a.casefile).slug), F.col("id"))).first()[0]
            return {"citation": text, "quote": p.text}
        case _:
            return w.repair_mention_offsets(a.casefile).asDict()


def evaluated(w: Workspace, a: argparse.Namespace) -> dict:
    """Measure the legs on a set of judgements, hold them against a recorded baseline, and record them only where that is asked for."""
    legs, languages, conditions = w.measure(a.casefile, evaluate.load_judgements(w.spark, a.judgements), a.limit)
    out: dict = evaluate.measurement(conditions, legs, languages)
    if a.baseline:
        with open(a.baseline, encoding="utf-8") as f:
            before = json.load(f)
        out["differs_in"] = evaluate.comparable(conditions, before["conditions"])
        out["regressions"] = [(leg, m, v, out["metrics"].get(leg, {}).get(m)) for leg, own in before["metrics"].items() for m, v in own.items() if m != "queries" and out["metrics"].get(leg, {}).get(m, 0.0) < v - evaluate.TOLERANCE]
    if a.record:
        evaluate.write_baseline(a.record, conditions, legs, languages)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        spark = spark or SparkSession.builder.appName("caseweave").getOrCreate()
        if a.config:
            with open(a.config, encoding="utf-8") as f:
                w, _ = open_workspace(spark, f.read(), path=a.path)
        else:
            w = Workspace(spark, a.path)
        result, code = run(w, a), 0
    except CaseweaveError as e:
        result, code = error_payload(e), 1
    print(json.dumps(result, default=str, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
