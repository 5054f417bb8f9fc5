import random

import pytest
from pyspark.sql import functions as F

from caseweave.llm import decontam as D
from tests.llm.fixtures import SF, documents


def brute_scores(index, words):
    """Every unit's score by going through all postings."""
    out = {}
    for w in set(words):
        t = index.terms.get(w, 0)
        for at in range(index.starts[t], index.starts[t + 1]):
            out[int(index.units[at])] = out.get(int(index.units[at]), 0.0) + index.scores[at]
    return out


def world(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{text(rng.randint(3, 40))}{rng.choice(['?', chr(10), ''])} {text(rng.randint(0, 80))}") for i in range(120)]
    return rng, text, items


def test_wand_returns_all_above_the_threshold():
    rng, text, items = world()
    index = D.build(items)
    for _ in range(150):
        words = D.words_of(text(rng.randint(1, 64)) + " " + rng.choice(items)[1][: rng.randint(0, 200)])
        for threshold in (0.15, 0.4, 0.6):
            want = {u: s for u, s in brute_scores(index, words).items() if s >= threshold - 1e-9}
            got = dict(D.wand(index, [index.terms[w] for w in set(words) if w in index.terms], threshold))
            assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in got)


def brute_found(index, words, threshold):
    half, out = D.PASSAGE // 2, set()
    for p in range(max(1, -(-len(words) // half) - 1)):
        for u, s in brute_scores(index, words[p * half : p * half + D.PASSAGE]).items():
            if s >= threshold - 1e-9:
                out.add((p, int(index.unit_item[u])))
    return out


@pytest.mark.parametrize(("dense", "entries"), [(D.DENSE, D.ENTRIES), (10, 50)])
def test_bounds_lose_no_passage(monkeypatch, dense, entries):
    monkeypatch.setattr(D, "DENSE", dense)
    monkeypatch.setattr(D, "ENTRIES", entries)
    rng, text, items = world(9)
    index = D.build(items)
    texts = [D.words_of(" ".join([text(rng.randint(0, 300)), rng.choice(items)[1] if rng.random() < 0.5 else "", text(rng.randint(0, 90))])) for _ in range(60)] + [[]]
    for threshold in (0.3, 0.6):
        assert D.find(index, list(map(index.numbers, texts)), threshold) == [brute_found(index, t, threshold) for t in texts]


def test_planted_items(spark):
    rng, text, items = world(2)
    items = [(i, t) for i, t in items if len(D.words_of(t)) >= 12]
    rows, want = [], {}
    for d in range(80):
        i, item = rng.choice(items)
        kind = d % 4
        if kind == 0:
            item = item.upper().replace(" ", " , ")
        elif kind == 1:  # one word of twelve or more changed at the edge
            item = "changed " + item.split(" ", 1)[1]
        elif kind == 2:  # half of it is no leak
            words = item.split()
            item = " ".join(words[: len(words) // 2])
        else:
            item = ""
        rows.append((d, f"{text(rng.randint(0, 400))} {item} {text(rng.randint(0, 50))}"))
        want[d] = i if kind in (0, 1) else None
    rows += [(200, None), (201, ""), (202, "x " * 50000 + items[0][1] + " y" * 50000), (202, "x " * 50000 + items[0][1] + " y" * 50000), (None, items[1][1])]
    want |= {200: None, 201: None, 202: items[0][0], None: items[1][0]}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaked", F.lit("clash")).withColumn("item_id", F.lit(1)).withColumn("overlap", F.lit(2))
    bench = spark.createDataFrame([*items, (998, None), (999, " ?! "), items[0]], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = D.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.contaminated == (want[r.doc_id] is not None), r
        assert want[r.doc_id] is None or want[r.doc_id] in r.item_ids
    docs = docs.selectExpr("*", "'own' as dc_text", "2 as Dc_Leaked", "3 as dc_key", "4 as dc_leaks")
    kept = D.drop_contaminated(docs, bench)
    clean = [tuple(r) for r in docs.collect() if want[r.doc_id] is None]
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(clean, key=str)
    # groups of items find the same
    again = D.with_leaks(docs, bench, "found", group_bytes=3000).select("doc_id", "dc_key", F.transform("found", lambda x: x["item_id"]).alias("i")).collect()
    assert sorted((str(r.doc_id), r.dc_key, sorted(r.i)) for r in again) == sorted((str(r.doc_id), 3, sorted(r.item_ids)) for r in got)


def test_tables_and_empty(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = documents(spark)
    got = {r.doc_id for r in D.contamination(docs, bench).filter("contaminated").collect()}
    items = [r.text for r in bench.collect()]
    assert got >= {r.doc_id for r in docs.collect() if any(t in r.text for t in items)}
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def brute_shares(item, words):
    """(whole, question, answer) shares over a whole text, by counting."""
    question, answer = D.parts_of(item)

    def share(part):
        if not part:
            return 1.0
        if len(part) >= 10:
            own = {tuple(part[i : i + 5]) for i in range(len(part) - 4)}
            return len(own & {tuple(words[i : i + 5]) for i in range(len(words) - 4)}) / len(own)
        return max(sum(0 <= at + i < len(words) and words[at + i] == w for i, w in enumerate(part)) for at in range(1 - len(part), len(words) or 1)) / len(part)

    return share(question + answer), share(question), share(answer)


def brute_leak(item, words):
    whole, question, answer = brute_shares(item, words)
    parts = D.parts_of(item)
    return whole >= 0.8 and min(question, answer) >= 0.5 or bool(parts[1]) and len(parts[0]) + len(parts[1]) >= 5 and min(question, answer) >= 0.8


def test_verdict_against_brute_force():
    """Items with changed words in the question, the answer or both, alone in short texts that one passage spans."""
    rng, n = random.Random(13), [0, 0]
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 25))) + "? " + " ".join(word() for _ in range(rng.choice([1, 3, 6, 12, 20])))) for i in range(60)]
    index = D.build(items)
    for _ in range(300):
        i, text = rng.choice(items)
        question, answer = D.parts_of(text)
        change = lambda part, share: [w if rng.random() >= share else b"changed" for w in part]
        said = change(question, rng.choice([0, 0, 0.05])) + change(answer, rng.choice([0, 0, 0.1, 0.5, 1]))
        words = [word().encode() for _ in range(rng.randint(0, 8))] + said + [word().encode() for _ in range(rng.randint(0, 8))]
        got = [x for x in next(D.leaks(index, [b" ".join(words).decode()])) if x[0] == i]
        want = brute_leak(text, words)
        n[want] += 1
        assert bool(got) == want and (not got or got[0][1:] == pytest.approx(brute_shares(text, words))), (text, words)
    assert min(n) > 30


def test_another_answer_is_no_leak():
    question = " ".join(f"q{i}" for i in range(22)) + "?"
    index = D.build([(1, f"{question} the true answer")])
    found = [bool(x) for x in D.leaks(index, [f"{question} some other words", f"so {question.upper()} It is the true answer.", f"{question} {'and ' * 200} the true answer", question])]
    assert found == [False, True, False, False]


def test_an_index_of_a_large_benchmark_is_small():
    rng = random.Random(1)
    vocab = [f"w{int(rng.paretovariate(0.5)) % 60000}" for _ in range(100000)]
    items = [(i, " ".join(rng.choices(vocab, k=80))) for i in range(4000)]
    parts = D.index_parts(items)
    size, made = sum(len(t) for _, t in items), sum(x.nbytes for x in parts[2:]) + len(parts[1])
    assert made < 10 * size
