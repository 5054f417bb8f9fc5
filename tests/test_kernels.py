"""Kernels and operators against hand-derived results, a second implementation, or SQLite's own ranking."""

import random
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseweave import errors
from caseweave.functions import chunking, identifiers, windows
from caseweave.functions.embedding import HashEmbedder
from caseweave.functions.enrich import numbered_notes, summarise
from caseweave.functions.text import fold, join_location, one_line, tokens
from caseweave.operators import corpus, coverage, evaluate, facets, pages, records, search
from caseweave.operators import windows as window_ops
from caseweave.sources.sniff import is_bitmap, sniff


@given(st.text(alphabet="ab \n#é😀\t", max_size=300), st.integers(2, 60), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_offsets_select_the_passage(text, size, overlap):
    overlap = min(overlap, size - 1)
    got = chunking.passages(text, size, overlap)
    assert [g[0] for g in got] == list(range(len(got)))
    covered = set()
    for _, body, start, end, _ in got:
        assert text[start:end] == body == body.strip() != ""
        covered |= set(range(start, end))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_strided_and_kernel_agree(spark):
    texts = ["", "  ", "x" * 5000, "word " * 700 + "  ", "é😀 " * 1500, " " * 2500 + "tail", " lead " * 300, "a\n" * 1800]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumns({"document_id": F.col("doc_id").cast("string"), "casefile_id": F.lit("c")})
    got = sorted((r.doc_id, r.ordinal, r.text, r.char_start, r.char_end) for r in corpus.chunks(docs, 2000, 200).collect())
    want = sorted((i, o, body, a, b) for i, t in enumerate(texts) for o, body, a, b, _ in chunking.passages(t, 2000, 200))
    assert got == want


def test_identifiers_positive_other_spelling_and_near_miss():
    one = lambda find, text: [(v, n) for v, n, _, _ in find(text)]
    assert one(identifiers.emails, "Send to Ada.Lind@Ports.example today, root@localhost") == [("Ada.Lind@Ports.example", "ada.lind@ports.example")]
    assert one(identifiers.phones, "call +44 (20) 7946-0018 now, +442079460018, ref +1234567") == [("+44 (20) 7946-0018", "+442079460018"), ("+442079460018", "+442079460018")]
    assert one(identifiers.ibans, "to DE89 3704 0044 0532 0130 00 was; DE89 3704 0044 0532 0310 00") == [("DE89 3704 0044 0532 0130 00", "DE89370400440532013000")]
    assert one(identifiers.ibans, "DE89 3704 0044\n0532 0130 00") == []
    assert one(identifiers.registration_numbers, "ЄДРПОУ 12345678, тел. +380441234567 та 87654321") == [("12345678", "12345678")]
    assert identifiers.normalise("gb82 west 1234 5698 7654 32", "iban") == "GB82WEST12345698765432" and identifiers.normalise("see a@b.example") == "see a@b.example"


def test_mentions_of_native_patterns_equal_the_kernels(spark):
    text = "😀 a@b.example é +44 20 7946 0018, A@B.example +1 (303) 555-0199 x@y.z.example+49 30 901820 "
    chunks = spark.createDataFrame([("k", "d", "c", 1, 0, 7, text), ("k2", "d", "c", 1, 1, 50, "none")], "chunk_id string, document_id string, casefile_id string, doc_id int, ordinal int, char_start int, text string")
    got = sorted((r.kind, r.value, r.normalised, r.char_start, r.char_end, r.document_offset) for r in corpus.mentions(chunks).collect())
    assert got == sorted((k, v, n, a, b, 7 + a) for k, find in identifiers.FINDERS.items() for v, n, a, b in find(text))
    assert len(got) >= 5


def test_mention_arguments():
    assert search.parse_mention("") == ("", "") and search.parse_mention("EMAIL:A@b.example") == ("email", "a@b.example") and search.parse_mention("A@b.example") == ("", "a@b.example")
    for bad in ("email:", "passport:1", "a:b@example.com"):
        with pytest.raises(errors.ValidationError):
            search.parse_mention(bad)


def test_bm25_equals_sqlite(spark):
    texts = ["the quick brown fox", "the lazy dog the dog", "Crème brûlée for the fox", "quick quick quick dog", "nothing here", "the КИЇВ dog", "київ fox fox", "brown the", "the the", "dog_fox brown"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", enumerate(texts))
    rows = spark.createDataFrame([(f"k{i}", "d", "c", i, t) for i, t in enumerate(texts)], "chunk_id string, document_id string, casefile_id string, ordinal int, text string")
    for query in (["fox"], ["creme", "dog"], ["київ", "brown", "brown"], ["the"], ["quick", "absent"]):
        want = {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(f'"{q}"' for q in query),))}
        got = {r.ordinal: r.score for r in search.scored(rows, query).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in got), query
        post = search.postings_leg(corpus.stored_postings(rows), corpus.passage_statistics(rows), rows, "c", query, 100)
        assert {r.ordinal: round(r.score, 8) for r in post.collect()} == {k: round(v, 8) for k, v in want.items()}


def test_ties_do_not_follow_ids(spark):
    for names in (("a", "b"), ("z", "y")):
        legs = spark.createDataFrame([(names[0], 1, 2, 0, "first"), (names[1], 2, 1, 0, "second")], "chunk_id string, k int, v int, ordinal int, text string")
        fused = search.fuse(legs.select("chunk_id", F.col("k").alias("keyword_rank")), legs.select("chunk_id", F.col("v").alias("vector_rank"))).join(legs, "chunk_id").orderBy(*search.fused_order()).collect()
        assert [r.text for r in fused] == ["first", "second"] and fused[0].score == fused[1].score == pytest.approx(1 / 61 + 1 / 62)


def test_filters_stand_below_the_limit(spark):
    rows = spark.createDataFrame([(f"k{i}", "d", "c" if i % 2 else "other", i, "fox " * (60 - i) + "pad " * i) for i in range(60)], "chunk_id string, document_id string, casefile_id string, ordinal int, text string")
    carriers = spark.createDataFrame([("k59",), ("k58",)], "chunk_id string")
    leg = search.keyword_leg(rows, "c", ["fox"], 5, carriers)
    assert [r.chunk_id for r in leg.collect()] == ["k59"]  # far below the best five
    plan = leg._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("GlobalLimit") < plan.index("LeftSemi") and plan.index("GlobalLimit") < plan.index("casefile_id")
    vectors = spark.createDataFrame([(f"k{i}", [float(i), 0.0]) for i in range(60)], "chunk_id string, embedding array<float>")
    assert [r.chunk_id for r in search.vector_leg(vectors, [0.0, 0.0], 3, "chunk_id", carriers=carriers).collect()] == ["k58", "k59"]
    with pytest.raises(Exception, match="not 3 wide"):
        search.vector_leg(vectors, [0.0, 0.0, 0.0], 3, "chunk_id").collect()
    gap = vectors.select(search.distance(F.col("embedding"), [3.0, 4.0]).alias("d")).first().d
    assert gap == pytest.approx(5.0)


def test_hybrid_and_reranking(spark):
    rows = spark.createDataFrame([(f"k{i}", "d", "c", i, t) for i, t in enumerate(["red fox", "red", "blue fox fox", "green", "a fox red"])], "chunk_id string, document_id string, casefile_id string, ordinal int, text string")
    e = HashEmbedder(64)
    assert search.hybrid(rows, "c", "red fox", e, 2).orderBy("position").first().text == "red fox"
    by_length = search.hybrid(rows, "c", "red fox", e, 3, scorer=lambda t: F.length(t).cast("double")).orderBy("position").collect()
    assert by_length[0].text == "blue fox fox" and {r.ranking for r in by_length} == {"rerank"}

    @F.udf("double")
    def gone(text):
        raise errors.RerankUnavailable("down")

    assert {r.ranking for r in search.hybrid(rows, "c", "red fox", e, 3, scorer=gone).collect()} == {"rerank-unavailable"}
    for blank in ("", "  "):
        with pytest.raises(errors.ValidationError):
            search.hybrid(rows, "c", blank, e)
    assert search.keyword_leg(rows, "c", search.query_terms(spark, "!!"), 5).count() == 0


def test_overlap_counts_once(spark):
    text = "x" * 150 + " a@b.example " + "y" * 100
    docs = spark.createDataFrame([(1, text), (2, "a@b.example"), (3, "A@B.example a@b.example")], "doc_id int, text string").withColumns({"document_id": F.col("doc_id").cast("string"), "casefile_id": F.lit("c")})
    found = corpus.mentions(corpus.chunks(docs, 200, 60))
    assert [(r.value, r.mentions, r.documents) for r in facets.facets(found, "c").collect() if r.value == "a@b.example"] == [("a@b.example", 4, 3)]
    page = facets.carriers_page(found, docs, "c", "a@b.example")
    assert page.total == 3 and [(r.doc_id, r.mentions) for r in page.rows.collect()] == [(3, 2), (1, 1), (2, 1)]
    with pytest.raises(errors.ValidationError):
        facets.carriers(found, docs, "c", "")
    with pytest.raises(errors.ValidationError):
        facets.facets(found, "c", "passport")


def test_pages_sweep_and_end(spark):
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    swept, at = [], 0
    while at is not None:
        p = pages.page(df, [F.asc("k"), F.asc("id")], at, 2)
        swept += [r.id for r in p.rows.collect()]
        at = p.continue_from
    assert swept == [0, 2, 4, 1, 3]
    end = pages.page(df, [F.asc("id")], 10, 2)
    assert end.rows.count() == 0 and end.beyond_the_end and not end.truncated and end.continue_from is None
    assert pages.clamped(-3, 0) == (0, 1) and pages.clamped(2**70, 10**9) == (2**63 - 1, pages.PAGE_MOST)
    assert pages.page(df, [F.asc("id")], 2**70, 5).rows.count() == 0
    named = spark.createDataFrame([("abc1", "s"), ("abd2", "t")], "id string, slug string")
    assert pages.resolve(named, "abc").id == "abc1" and pages.resolve(named, "t", slug="slug").id == "abd2"
    with pytest.raises(errors.AmbiguousReferenceError):
        pages.resolve(named, "ab")
    with pytest.raises(errors.NotFoundError):
        pages.resolve(named, "a%")


def runs(spark, *rows):
    return spark.createDataFrame([(str(i), "c", i, a, b, 0, f, 0, 0, "") for i, (a, b, f) in enumerate(rows)], "id string, casefile_id string, started_at int, documents_before int, documents_after int, items_ingested int, items_failed int, entries_refused int, files_without_extractor int, exhausted_by string")


def test_coverage_precedence(spark):
    one = spark.createDataFrame([("c",)], "casefile_id string")
    says = lambda *r: tuple(coverage.verdicts(one, runs(spark, *r)).select("verdict", "ground").first())
    assert says((0, 3, 0), (3, 5, 0), (7, 8, 0)) == ("unknown", "continuity-break")
    assert says((0, 3, 0), (3, 5, 1), (7, 8, 0)) == ("incomplete", "")
    assert says((2, 3, 0), (3, 5, 0)) == ("unknown", "documents-predate") and says((0, 3, 0), (3, 5, 0)) == ("complete", "") and says() == ("unknown", "no-runs")


def test_paths_lines_and_folding(spark):
    df = spark.createDataFrame([("/d", "./n.txt"), ("/", "n.txt"), ("/d", "/abs//x"), ("/d//e/", "f")], "r string, p string")
    assert [r[0] for r in df.select(join_location(F.col("r"), F.col("p"))).collect()] == ["/d/n.txt", "/n.txt", "/abs/x", "/d/e/f"]
    lines = spark.createDataFrame([("a \n  b",), ("x" * 10,)], "t string").select(one_line(F.col("t"), 5)).collect()
    assert [r[0] for r in lines] == ["a b", "xxxx…"]
    got = spark.createDataFrame([("Crème_BRÛLÉE йод Їжак",)], "t string").select(tokens(F.col("t")), fold(F.col("t"))).first()
    assert got[0] == ["creme", "brulee", "йод", "їжак"]


def hit(start, end, text, ordinal=0, trail="", near=(), doc="d"):
    return windows.Hit(doc, ordinal, start, end, trail, text[start:end].strip(), text, list(near))


def test_windows():
    text = "# A\n" + "a" * 96 + "\n# B\n" + "b" * 95
    h = hit(40, 60, text, 1, "A", [(0, 0, 45, "A"), (2, 55, 200, "A"), (3, 150, 200, "B")])
    assert windows.section(h) == (0, 200)
    span, narrowed = windows.window(h, windows.Sheet(text), 100)
    assert (span, narrowed) == ((0, 100), False)
    assert windows.window(h, windows.Sheet(text), 20) == (None, False)
    assert windows.widened(40, 60, (30, 200), 100) == (30, 130) and windows.widened(40, 60, (0, 65), 100) == (0, 65)
    assert windows.Sheet(text, [(40, 60), (70, 90), (10, 20)]).unmatched(40, 60, (0, 200)) == (20, 70) and windows.Sheet(text, [(50, 90), (40, 60)]).unmatched(40, 60, (0, 200)) == (0, 60)
    stale = hit(40, 60, text)
    stale.passage = "not there"
    assert windows.window(stale, windows.Sheet(text), 100) == (None, False)
    served = windows.response([h, hit(70, 80, text, 2, "A", [(1, 40, 60, "A")])], 100)
    assert served == [((0, 70), True), (None, True)]
    assert all(s is None for s, _ in windows.response([h], 100, bound=10))


def test_spans_against_sets():
    rng = random.Random(3)
    for _ in range(200):
        spans, cells = windows.Spans(), set()
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 50)
            b = a + rng.randint(1, 12)
            spans.add(a, b)
            cells |= set(range(a, b))
        assert {i for a, b in zip(spans.starts, spans.ends, strict=True) for i in range(a, b)} == cells
        assert all(b < a for b, a in zip(spans.ends, spans.starts[1:], strict=False))
        low = rng.randint(0, 60)
        high = low + rng.randint(1, 6)
        got = spans.gap(low, high, 100)
        assert (got is None) == bool(cells & set(range(low, high)))
        if got:
            assert got == (max((c + 1 for c in cells if c < low), default=0), min((c for c in cells if c >= high), default=100))


def test_windows_of_a_response_keep_their_rules():
    """Random hits of two documents: windows hold their passage, lie in its section, apart from each other and from other passages."""
    rng = random.Random(8)
    for _ in range(120):
        texts = {d: "".join(rng.choice(["word ", "word ", "word ", "\n\n## Head\n"]) for _ in range(rng.randint(20, 200))) for d in "ab"}
        cut = {d: chunking.passages(t, 120, 20) for d, t in texts.items()}
        chosen = rng.sample([(d, p) for d in "ab" for p in cut[d]], k=min(6, sum(map(len, cut.values()))))
        hits = [hit(p[2], p[3], texts[d], p[0], p[4], [(q[0], q[2], q[3], q[4]) for q in cut[d] if abs(q[0] - p[0]) <= 3], d) for d, p in chosen]
        budget, bound = rng.choice([200, 400]), rng.choice([500, 60_000])
        served = windows.response(hits, budget, bound)
        shown = {d: [] for d in "ab"}
        spent = 0
        for h, (span, _) in zip(hits, served, strict=True):
            spent += span[1] - span[0] if span else 0
            if span:
                low, high = windows.section(h)
                assert low <= span[0] <= h.start and h.end <= span[1] <= high and span[1] - span[0] <= max(budget, h.end - h.start)
                assert not re.search("(?m)^## Head", h.text[h.end : span[1]])
                others = [o.span for o in hits if o.document_id == h.document_id and o.span != h.span]
                assert not any(max(a, span[0]) < min(b, span[1]) and not (a < h.end and b > h.start) for a, b in others)
                assert not any(max(a, span[0]) < min(b, span[1]) for a, b in shown[h.document_id])
            shown[h.document_id].append(span or h.span)
        assert spent <= bound


def test_outline_against_lines():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["# One", "## Two ", "###### Six", "####### no", "#no", " # In\t", "text", "\n", "\r\n", "\n\n", "\u2028", " ", "#", "# "]) for _ in range(rng.randint(0, 25)))
        starts, trails, above, at = [], [], [], 0
        for line in text.splitlines(keepends=True):
            if (found := re.fullmatch(r"(#{1,6})\s+(\S.*)", line.strip())) is not None:
                above = [h for h in above if h[0] < len(found[1])] + [(len(found[1]), found[2].strip())]
                starts.append(at)
                trails.append(" > ".join(n for _, n in above))
            at += len(line)
        outline = chunking.Outline(text)
        assert (outline.starts, outline.trails) == (starts, trails), text


def test_result_windows_over_frames(spark):
    text = "# A\n\n" + "alpha " * 60 + "\n\n# B\n\n" + "beta " * 10
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string").withColumns({"document_id": F.lit("d"), "casefile_id": F.lit("c")})
    chunks = corpus.chunks(docs, 120, 20)
    hits = chunks.filter("ordinal = 1").select(F.lit(1).alias("query_id"), F.lit(1).alias("position"), "chunk_id")
    got = window_ops.result_windows(hits, chunks, docs, 300).first()
    assert got.window_text == text[got.window_start : got.window_end] and "# B" not in got.window_text and len(got.window_text) <= 300


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "k", 1, True), (1, "k", 2, True), (2, "k", 4, True), (3, "k", 1, False)], "query_id int, leg string, rank int, relevant boolean")
    m = evaluate.metrics(ranked, spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int"))
    r = m.first()
    assert (r.queries, r.recall_at_1, r.recall_at_5, r.recall_at_10, r.mrr_at_10) == (4, 0.25, 0.5, 0.5, pytest.approx((1 + 0.25) / 4))
    worse = m.withColumn("mrr_at_10", F.lit(0.1))
    assert [x.metric for x in evaluate.regressions(worse, m).collect()] == ["mrr_at_10"] and evaluate.regressions(m, m).isEmpty()
    assert evaluate.comparable({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b"]
    rel = spark.createDataFrame([("f", "The  Quick\nfox", "f", "quick FOX"), ("g", "quick fox", "f", "quick fox")], "a string, t string, w string, p string")
    assert [x[0] for x in rel.select(evaluate.is_relevant(*map(F.col, "atwp"))).collect()] == [True, False]


def test_batch_leg_equals_the_single_one(spark):
    rows = spark.createDataFrame([(i, f"fox {'dog ' * (i % 4)}{'red ' * (i % 3)} é{i}") for i in range(40)], "doc_id long, text string")
    got = search.batch_keyword(rows, [(7, "Fox dog"), (9, "red É3")], 5).collect()
    one = rows.select(F.col("doc_id").alias("ordinal"), "text")
    for q, terms in ((7, ["fox", "dog"]), (9, ["red", "e3"])):
        want = sorted(((-round(r.score, 9), r.ordinal) for r in search.scored(one, terms).collect()))[:5]
        assert [(-r.score, r.doc_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_enrichment():
    class Fixed:
        name = "fixed"

        def passages(self, document, texts):
            return [t.upper() for t in texts]

        def document(self, notes):
            return notes

    assert summarise(Fixed(), "d", ["a", "b"]) == (["A", "B"], "1. A\n2. B")
    with pytest.raises(ValueError):
        summarise(Fixed(), "d", ["a", " "])
    assert numbered_notes(["x" * 30, "y"], 10) == ""
    assert sniff(b"BM" + bytes(40)) is None and not is_bitmap(b"BM") and sniff(b"") is None


def test_unknown_passage_is_an_error(spark):
    chunks = spark.createDataFrame([("k", "d", "c", 5)], "chunk_id string, document_id string, casefile_id string, char_start int")
    found = spark.createDataFrame([("nope", "x", "y", 1, 1)], "chunk_id string, document_id string, casefile_id string, char_start int, document_offset int")
    with pytest.raises(errors.ValidationError):
        records.derive_mentions(found, chunks)
    ok = records.derive_mentions(found.withColumn("chunk_id", F.lit("k")), chunks).first()
    assert (ok.document_id, ok.casefile_id, ok.document_offset) == ("d", "c", 6)
