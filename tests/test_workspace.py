import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from caseweave import errors, schemas
from caseweave.functions import models
from caseweave.functions.embedding import HashEmbedder
from caseweave.identity import Contract, escape, verify
from caseweave.operators import corpus, evaluate, search
from caseweave.sources import ingest, readers
from caseweave.streaming.inbox import watch
from caseweave.surface import cli
from caseweave.workspace import Workspace, open_workspace

MAIL = b"From: Ada <ada@ports.example>\r\nTo: b@ports.example\r\nSubject: Cargo\r\nContent-Type: multipart/mixed; boundary=X\r\n\r\n--X\r\nContent-Type: text/plain\r\n\r\nthe vessel sails on Friday, call +44 20 7946 0018\r\n--X\r\nContent-Type: text/plain; name=a.txt\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nattached manifest of goods\r\n--X--\r\n"


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def dump(folder):
    (folder / "sub").mkdir(parents=True)
    (folder / "note.txt").write_text("The captain wrote to ada@ports.example about the vessel.")
    (folder / "sub" / "again.txt").write_text("The captain wrote to ada@ports.example about the vessel.")
    (folder / "mail.eml").write_bytes(MAIL)
    (folder / "box.zip").write_bytes(zipped({"in/one.md": "# Deep\n\nburied text about a vessel", "inner.zip": zipped({"two.txt": "second level"}), "../evil.txt": "x", "odd.xyz": "binary"}))
    (folder / "sheet.csv").write_text("a,b\n\n1, 2  3\n")
    (folder / "empty.txt").write_text(" \n")
    (folder / "unknown.qqq").write_bytes(b"\x00\x01")
    (folder / "disguised.dat").write_bytes(zipped({"x.txt": "routed by content"}))
    return str(folder)


def test_workspace_end_to_end(spark, tmp_path, capsys):
    root, path = dump(tmp_path / "dump"), str(tmp_path / "store")
    w = Workspace(spark, path)
    case = w.create_casefile("Harbour Inquiry")
    assert case.slug == "harbour-inquiry"
    with pytest.raises(errors.ConflictError):
        w.create_casefile("Harbour inquiry")
    run = w.ingest("harbour-inquiry", root)
    names = sorted(r.containment_path for r in w.table("documents").collect())
    assert names == ["box.zip", "box.zip/in/one.md", "box.zip/inner.zip", "box.zip/inner.zip/two.txt", "disguised.dat", "disguised.dat/x.txt", "mail.eml", "mail.eml/a.txt", "note.txt", "sheet.csv"]
    assert (run.items_ingested, run.items_failed, run.entries_refused, run.files_without_extractor) == (11, 1, 2, 1)
    assert [r.location_path.rsplit("dump/")[-1] for r in w.locations(case.slug, w.table("documents").filter("filename = 'note.txt'").first().id)] == ["note.txt", "sub/again.txt"]
    assert w.coverage(case.slug).verdict == "incomplete"
    hits = w.search(case.slug, "vessel", 5).orderBy("position").collect()
    assert hits and all("vessel" in h.text for h in hits[:3])
    only = w.search(case.slug, "vessel", 5, mention="email:Ada@Ports.example").collect()
    assert {h.document_id for h in only} == {r.document_id for r in w.table("mentions").filter("normalised = 'ada@ports.example'").collect()}
    assert [(r.kind, r.value, r.mentions) for r in w.mentions(case.slug).collect()][0] == ("email", "ada@ports.example", 2)
    page = w.mention_documents(case.slug, "ada@ports.example")
    assert page.total == 2 and not page.truncated
    before = {r.id: r.created_at for r in w.table("documents").collect()}
    chunks = sorted(r.chunk_id for r in w.table("chunks").collect())
    w.ingest(case.slug, root)  # the same again: same ids, same creation, one more run
    assert {r.id: r.created_at for r in w.table("documents").collect()} == before and sorted(r.chunk_id for r in w.table("chunks").collect()) == chunks
    assert w.table("ingest_runs").count() == 2
    assert w.repair_mention_offsets(case.slug).repaired == 0
    box = w.table("documents").filter("filename = 'two.txt'").first()
    assert len(w.containment_chain(case.slug, box.id[:12])) == 2
    assert cli.main([path, "search", "harbour-inquiry", "vessel"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["results"]
    assert cli.main([path, "casefile-show", "nobody"], spark) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["status"] == 404
    passage = w.table("chunks").filter("heading_path = '' AND text LIKE 'The captain%'").first()
    assert cli.main([path, "cite", "harbour-inquiry", passage.chunk_id[:10]], spark) == 0
    assert "(chars 0–" in capsys.readouterr().out
    w.delete_document(case.slug, w.table("documents").filter("filename = 'box.zip'").first().id)
    assert w.table("documents").count() == 6 and w.table("chunk_vectors").count() == w.table("chunks").count()
    w.update_casefile(case.slug, title="Port", slug="port")
    with pytest.raises(errors.NotFoundError):
        w.casefile("harbour-inquiry")
    with pytest.raises(errors.ConfigError):
        Workspace(spark, path, Contract(chunk_max_chars=100, chunk_overlap_chars=10))
    w.delete_casefile("port")
    assert all(w.table(t).count() == 0 for t in ("casefiles", "documents", "chunks", "chunk_vectors", "mentions", "document_places", "ingest_runs"))


class Notes:
    """A summariser that says which passage it was given."""

    name = "notes"

    def passages(self, document, texts):
        return [f"about {i} {t[:4]}" for i, t in enumerate(texts)]

    def document(self, notes):
        return f"{len(notes.splitlines())} notes"


def test_new_documents_add_folders_and_known_ones_replace(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.md").write_text(f"# {name}\n\nthe {name} vessel " + "left port quietly. " * 200)
    w = Workspace(spark, str(tmp_path / "store"), Contract(summariser="notes"), summariser=Notes())
    case, other = w.create_casefile("Port"), w.create_casefile("Other")
    first = w.ingest("port", str(tmp_path / "one"))
    assert (first.documents_before, first.documents_after, first["first"]) == (0, 1, 1)
    w.ingest("other", str(tmp_path / "two"))
    w.ingest("port", str(tmp_path / "two"))
    folders = w._manifest()[1]
    assert len(folders["chunks"][case.id]) == 2 and len(folders["chunks"][other.id]) == 1
    third = w.ingest("port", str(tmp_path / "one"))  # known by now
    assert (third.documents_before, third.documents_after, third["known"], third["first"]) == (2, 2, 1, 0) and len(w._manifest()[1]["chunks"][case.id]) == 1
    assert w._manifest()[1]["chunks"][other.id] == folders["chunks"][other.id]  # not touched
    doc = w.table("documents", case.id).filter("filename = 'one.md'").first()
    passages = w.document_passages("port", doc.id).collect()
    assert doc.summary == f"{len(passages)} notes" and [p.summary for p in passages] == [f"about {i} {p.text[:4]}" for i, p in enumerate(passages)]
    # postings and statistics are those of the passages
    chunks = w.table("chunks")
    assert sorted(map(tuple, w.table("postings").collect())) == sorted(map(tuple, corpus.stored_postings(chunks).withColumn("dl", F.col("dl").cast("int")).collect()))
    assert w.table("passage_statistics").agg(F.sum("passages")).first()[0] == chunks.count()
    hits = w.search("port", "two vessel", 3).orderBy("position").collect()
    text = {r.id: r.extracted_text for r in w.table("documents", case.id).collect()}
    assert hits[0].text.startswith("# two") or "two vessel" in hits[0].text
    assert all(h.window_text is None or text[h.document_id][h.window_start : h.window_end] == h.window_text for h in hits) and any(h.window_text for h in hits)
    assert w.search("port", "nothinglikeit", 3, mention="email:no@one.example").count() == 0
    assert [r.id for r in w.document_ids("port").collect()] == [r.id for r in w.every_document("port").orderBy("created_at", "id").collect()]
    record = w.location_record("port", doc.id[:9])
    assert record["total"] == 1 and record["whole"] and record["note"] == ""
    # of two writers from one manifest the second is told, unless it changed something else
    base = w._manifest()
    w._commit({("mentions", case.id): w.table("mentions", case.id)}, base=base)
    with pytest.raises(errors.ConflictError):
        w._commit({("mentions", case.id): w.table("mentions", case.id)}, base=base)
    w._commit({("mentions", other.id): w.table("mentions", other.id)}, base=base)
    before = {n: w.table(n).count() for n in schemas.SCHEMAS}
    assert w.vacuum(keep=1) > 0 and {n: w.table(n).count() for n in schemas.SCHEMAS} == before
    for wrong in (dict(embedder=HashEmbedder(8)), dict(contract=Contract(summariser="notes")), dict(contract=Contract())):
        with pytest.raises(errors.ConfigError):
            Workspace(spark, str(tmp_path / "store"), **({"summariser": Notes()} | wrong if "embedder" in wrong else wrong))


def test_search_reads_postings_of_the_asked_terms(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("the vessel left port")
    w = Workspace(spark, str(tmp_path / "store"))
    case = w.create_casefile("Port")
    w.ingest("port", str(tmp_path / "d"))
    plan = search.scored_postings(w.table("postings"), w.table("passage_statistics"), case.id, ["vessel", "port"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "In(term, [port,vessel])" in scans[0].replace('"', "") or "In(term, [vessel,port])" in scans[0]
    assert "text" not in scans[0].split("ReadSchema")[1]


def test_a_store_of_version_one_is_brought_up_to_date(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("the vessel left port, mail ada@ports.example")
    w = Workspace(spark, str(tmp_path / "new"))
    w.create_casefile("Port")
    w.ingest("port", str(tmp_path / "d"))
    old = tmp_path / "old"
    names = [n for n in schemas.SCHEMAS if n not in ("postings", "passage_statistics")]
    for n in names:
        table = w.table(n)
        if n == "store_meta":
            table = table.withColumn("value", F.when(F.col("key") == "schema_version", "1").otherwise(F.col("value")))
        table.write.parquet(str(old / "snapshot-1" / n))
    (old / "manifest.json").write_text(json.dumps({n: f"snapshot-1/{n}" for n in names}))
    again = Workspace(spark, str(old))
    assert {r.key: r.value for r in again.table("store_meta").collect()}["schema_version"] == str(schemas.VERSION)
    for n in schemas.SCHEMAS:
        if n != "store_meta":
            assert sorted(map(str, again.table(n).collect())) == sorted(map(str, w.table(n).collect())), n
    assert [h.text for h in again.search("port", "vessel").collect()] == [h.text for h in w.search("port", "vessel").collect()]


def test_measures_by_leg_and_language(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    for name, text in (("a.txt", "the vessel left port"), ("b.txt", "корабель вийшов у море"), ("c.txt", "nothing of note")):
        (tmp_path / "d" / name).write_text(text)
    w = Workspace(spark, str(tmp_path / "store"))
    w.create_casefile("Port")
    w.ingest("port", str(tmp_path / "d"))
    given = [{"query": "vessel", "language": "en", "filename": "a.txt", "phrase": "Vessel  left"}, {"query": "корабель", "language": "uk", "filename": "c.txt", "phrase": "nowhere", "also": [{"filename": "b.txt", "phrase": "вийшов"}]}, {"query": "absent", "language": "en", "filename": "a.txt", "phrase": "vessel"}]
    (tmp_path / "j.json").write_text(json.dumps(given))
    legs, languages, conditions = w.measure("port", evaluate.load_judgements(spark, str(tmp_path / "j.json")), 1)
    recorded = evaluate.write_baseline(str(tmp_path / "baseline.json"), conditions, legs, languages)
    assert set(recorded["metrics"]) == {"keyword", "vector", "fused"} and recorded["metrics"]["keyword"]["recall_at_1"] == pytest.approx(2 / 3)
    assert recorded["by_language"]["uk"]["recall_at_1"] == 1.0 and json.loads((tmp_path / "baseline.json").read_text()) == recorded
    assert conditions["ranked_by"] == "fusion" and evaluate.regressions(legs, legs).count() == 0
    path = str(tmp_path / "store")
    assert cli.main([path, "evaluate", "port", str(tmp_path / "j.json"), "--limit", "1", "--baseline", str(tmp_path / "baseline.json")], spark) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["metrics"] == recorded["metrics"] and told["regressions"] == told["differs_in"] == []
    (tmp_path / "c.json").write_text(json.dumps({"contract": {"dimensions": 256}, "profile": {"store": "${HERE:-nowhere}"}}))
    assert cli.main([path, "--config", str(tmp_path / "c.json"), "document-ids", "port"], spark) == 0
    assert len(json.loads(capsys.readouterr().out.splitlines()[-1])["ids"]) == 3
    (tmp_path / "c.json").write_text(json.dumps({"contract": {"embedder": "e5"}}))
    assert cli.main([path, "--config", str(tmp_path / "c.json"), "document-ids", "port"], spark) == 1
    capsys.readouterr()
    w2, profile = open_workspace(spark, json.dumps({"profile": {"store": "${HERE}"}}), {"HERE": path})
    assert profile.store == path and w2.casefiles().count() == 1


def test_models_and_libraries():
    from importlib.metadata import PackageNotFoundError

    def gone(_):
        raise PackageNotFoundError

    assert models.canonical_library(" Fast_Embed == 1.2 ") == ("fast-embed", "1.2") and models.canonical_library("fastembed") is None
    assert models.same_release("1.2.0+cpu", "1.2") and not models.same_release("1.2.1", "1.2")
    assert models.library_mismatch("x==1.0", lambda _: "1.0.0") == "" and "1.1 is installed" in models.library_mismatch("x==1.0", lambda _: "1.1")
    assert "not installed" in models.library_mismatch("x==1", gone) and "can't be told" in models.library_mismatch("x==1", lambda _: None) and models.library_mismatch("x", gone)
    assert models.build_embedder(Contract()).name == "deterministic" and models.build_reranker() is None and models.build_summariser(Contract()) is None
    for wrong in (lambda: models.build_embedder(Contract(embedder="e5")), lambda: models.build_summariser(Contract(summariser="m")), lambda: models.build_embedder(Contract(embedder="e5"), "/nowhere").documents(["x"]), lambda: models.build_reranker("/nowhere").scores("q", ["t"])):
        with pytest.raises(errors.ConfigError):
            wrong()


def test_a_reranker_must_score_each_passage(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / f"{i}.txt").write_text("vessel " * (i + 1) + "port")

    class Scorer:
        name = "by length"

        def scores(self, query, texts):
            return [float(len(t)) for t in texts]

    class Short(Scorer):
        def scores(self, query, texts):
            return [1.0]

    class Down(Scorer):
        def scores(self, query, texts):
            raise OSError("no answer")

    w = Workspace(spark, str(tmp_path / "store"), reranker=Scorer())
    w.create_casefile("Port")
    w.ingest("port", str(tmp_path / "d"))
    hits = w.search("port", "vessel", 3).orderBy("position").collect()
    assert [len(h.text) for h in hits] == sorted((len(h.text) for h in hits), reverse=True) and {h.ranking for h in hits} == {"rerank"}
    with pytest.raises(errors.ConfigError):
        w.search("port", "vessel", 3, scorer=Short())
    assert {h.ranking for h in w.search("port", "vessel", 3, scorer=Down()).collect()} == {"rerank-unavailable"}


def test_budget_stops_at_the_first_bound(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.zip").write_bytes(zipped({f"f{i}.txt": "text " * (i + 1) for i in range(8)}))
    found, stopped = ingest.expand(ingest.scan(spark, str(tmp_path / "d")), items_most=3)
    assert stopped == "more than 3 expanded documents" and found.filter("depth = 1").count() == 3
    _, stopped = ingest.expand(ingest.scan(spark, str(tmp_path / "d")), bytes_most=60)
    assert stopped == "more than 60 extracted bytes"


def test_readers():
    assert readers.read("s t.csv", b"a,b\n,\nc,  d  e\n").text == "## sheet: s t\nrow 1: a | b\nrow 3: c | d e"
    got = readers.read("m.eml", MAIL)
    assert got.text.startswith("From: Ada <ada@ports.example>\nTo: b@ports.example\nSubject: Cargo\n\nthe vessel") and got.is_container
    box = b"From a@b Mon\nSubject: one\n\nhello\n\nFrom c@d Tue\n\nno subject here\n"
    assert readers.read("b.mbox", box).text == "one\n(no subject)"
    assert [n for n, _ in readers.children("b.mbox", box)] == ["message-00001.eml", "message-00002.eml"]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("x/y.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
        link = tarfile.TarInfo("l")
        link.type = tarfile.SYMTYPE
        t.addfile(link)
    got = readers.read("t.tar.gz", out.getvalue())
    assert got.text == "x/y.txt" and got.refusals == ["l: not a regular file"] and list(readers.children("t.tar.gz", out.getvalue())) == [("x/y.txt", b"hi")]
    html = b"<html><head><title>T</title><style>x</style></head><body><h2>Head</h2><p>one <b>two</b><br>three</p><script>no</script></body>"
    assert readers.read("p.html", html).text == "T\n\n## Head\n\none two\nthree"
    for name, data in (("a.rar", b"x"), ("a.txt", b""), ("a.txt", b"<!-- only -->"), ("a.docx", b"x"), ("z.zip", b"PK\x03\x04broken")):
        with pytest.raises(errors.ExtractionError):
            readers.read(name, data)
    assert readers.unsafe("/a") and readers.unsafe("a/../b") and readers.unsafe("C:/x") and readers.unsafe("d/") is None
    assert readers.route("x.bin", b"%PDF-1.4") == ("structural", ".pdf") and readers.route("x.bin", b"zzz") == (None, None)
    assert readers.best_rung([("text-layer", lambda: ("short", 1)), ("ocr", lambda: ("y" * 50, 1))]) == ("y" * 50, "ocr")
    assert readers.best_rung([("text-layer", lambda: ("z" * 200, 2)), ("ocr", lambda: 1 / 0)]) == ("z" * 200, "text-layer")


def test_identity():
    assert escape("a|b\\c\n=é") == "a\\x7cb\\x5cc\\x0a=é"
    assert Contract().identity() == "chunk_max_chars=2000|chunk_overlap_chars=200|embedder=deterministic|dimensions=256"
    verify(None, Contract())
    with pytest.raises(errors.ConfigError):
        Contract(chunk_max_chars=10, chunk_overlap_chars=10)


def test_inbox_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first file")
    go = lambda: watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "c", once=True).awaitTermination(120)
    go()
    (tmp_path / "in" / "b.zip").write_bytes(zipped({"c.txt": "inside"}))
    go()
    go()
    got = spark.read.parquet(f"{tmp_path}/out/documents").select("filename").collect()
    assert sorted(r.filename for r in got) == ["a.txt", "b.zip", "c.txt"]
    assert spark.read.parquet(f"{tmp_path}/out/outcomes").filter(F.col("status") != "ingested").count() == 0
