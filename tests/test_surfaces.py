import io
import json

import pytest

from caseweave import config, errors
from caseweave.operators import evaluate
from caseweave.surface import agent, api
from caseweave.workspace import Workspace


def test_routes_and_tools_agree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# Top\n\n" + "the vessel left port. " * 200 + "\n\nmail ada@ports.example\n")
    w = Workspace(spark, str(tmp_path / "store"))
    assert api.handle(w, "GET", "/health")[1]["status"] == "ok"
    assert api.handle(w, "POST", "/api/casefiles", {"title": "Port"})[0] == 200
    assert api.handle(w, "POST", "/api/casefiles", {"title": "Port"})[0] == 409
    assert api.handle(w, "POST", "/api/casefiles", {"title": ""})[0] == 400
    assert api.handle(w, "GET", "/api/casefiles/none")[0] == 404 and api.handle(w, "GET", "/nowhere")[0] == 404
    assert api.handle(w, "POST", "/api/casefiles/port/ingest", {"path": str(tmp_path / "d")})[1]["items_ingested"] == 1
    shown = api.handle(w, "GET", "/api/casefiles/port")[1]
    assert shown["coverage"]["verdict"] == "complete" and shown["statistics"]["documents"] == 1
    docs = api.handle(w, "GET", "/api/casefiles/port/documents")[1]
    doc = docs["documents"][0]["id"]
    assert docs["total"] == 1 and api.handle(w, "GET", f"/api/casefiles/port/documents/{doc[:8]}")[1]["id"] == doc
    passages = api.handle(w, "GET", f"/api/casefiles/port/documents/{doc}/passages", {"limit": "1"})[1]
    assert passages["truncated"] and passages["continue_from"] == 1 and "text" not in passages["passages"][0]
    found = api.handle(w, "GET", "/api/casefiles/port/search", {"q": "vessel"})[1]
    assert found["fence_nonce"] in found["results"][0]["text"]
    assert api.handle(w, "GET", "/api/casefiles/port/search", {"q": " "})[0] == 400 and api.handle(w, "GET", "/api/casefiles/port/search", {"q": "x", "limit": "y"})[0] == 400
    assert api.handle(w, "GET", "/api/casefiles/port/mentions")[1]["mentions"][0]["value"] == "ada@ports.example"
    assert api.handle(w, "GET", "/api/casefiles/port/mentions/documents", {"mention": "email:ada@ports.example"})[1]["total"] == 1
    chunk = found["results"][0]["chunk_id"]
    assert set(agent.TOOLS) == {f"case_{n}" for n in ("list_casefiles", "casefile_overview", "list_documents", "list_passages", "search", "mention_documents", "mentions", "get_passage", "read_document", "cite")}
    assert agent.call(w, "case_list_passages", casefile="port", document=doc)["total"] == len(w.table("chunks").collect())
    assert agent.call(w, "case_search", casefile="port", q="vessel", limit=10**6)["results"]
    got = agent.call(w, "case_get_passage", casefile="port", chunk_id=chunk)
    assert got["char_start"] <= got["matched_char_start"] < got["matched_char_end"] <= got["char_end"]
    assert agent.call(w, "case_read_document", casefile="port", document=doc, offset=5, length=10)["continue_from"] == 15
    assert "port/" in agent.call(w, "case_cite", casefile="port", chunk_id=chunk)["citation"]
    assert agent.call(w, "case_cite", casefile="port", chunk_id="zz")["status"] == 404 and agent.call(w, "case_cite", frozenset({"case_search"}))["status"] == 404
    body = json.dumps({"description": "d"}).encode()
    said = []
    out = api.application(w)({"REQUEST_METHOD": "PATCH", "PATH_INFO": "/api/casefiles/port", "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda s, h: said.append(s))
    assert said == ["200 OK"] and json.loads(out[0])["description"] == "d"
    assert api.handle(w, "DELETE", "/api/casefiles/port")[0] == 200 and w.casefiles().count() == 0


def test_config():
    contract, profile = config.parse('{"contract": {"chunk_max_chars": "${SIZE:-300}", "chunk_overlap_chars": 20}, "profile": {"host": "${HOST}"}}', {"HOST": "db.example"})
    assert (contract.chunk_max_chars, profile.host) == (300, "db.example") and config.parse("", {}) == (config.Contract(), config.Profile())
    for bad in ('{"x": 1}', '{"profile": {"nope": 1}}', '{"profile": {"port": 0}}', '{"profile": {"port": true}}', '{"profile": {"host": "a b"}}', '{"profile": {"host": "${GONE}"}}', '{"contract": {"embedder": 3}}', '{"profile": {"language": "x"}}', "[1]"):
        with pytest.raises(errors.ConfigError):
            config.parse(bad, {})


def test_judgements(spark, tmp_path):
    path = tmp_path / "j.json"
    path.write_text(json.dumps([{"query": "q", "language": "en", "filename": "a", "phrase": "p", "also": [{"filename": "b", "phrase": "r"}]}, {"query": "s", "language": "uk", "filename": "c", "phrase": "t"}]))
    assert sorted((r.query, r.filename) for r in evaluate.load_judgements(spark, str(path)).collect()) == [("q", "a"), ("q", "b"), ("s", "c")]
    path.write_text(json.dumps([{"query": " ", "language": "en", "filename": "a", "phrase": "p"}]))
    with pytest.raises(errors.ValidationError):
        evaluate.load_judgements(spark, str(path))
