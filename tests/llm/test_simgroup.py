import random

import numpy as np
import pyarrow as pa
import pytest

from caseweave.llm import buckets as B
from caseweave.llm import simgroup as G


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def roots(n, linked):
    part = list(range(n))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        part[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def family(seed, docs=40, copies=8):
    """Texts with copies at similarities well above and well below the threshold."""
    rng, out = random.Random(seed), []
    for d in range(docs):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 500))]
        out.append(" ".join(words))
        for k in range(rng.randint(0, copies)):
            copy = list(words)
            share = rng.choice([0.005, 0.012, 0.02, 0.03, 0.12, 0.3])  # of the words changed; each spoils five shingles
            for _ in range(max(1, round(share * len(copy)))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 5000)}"
            out.append(" ".join(copy).upper() if k == 0 else "\t".join(copy))
    return out


def test_column_sums():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 999, 1000, 2500):
        x = rng.integers(0, 2**63, (n, 2)).astype(np.uint64) * np.uint64(3)
        want = np.array([[int(v) >> b & 1 for w in row for v in [w] for b in range(64)] for row in x]).sum(axis=0)
        assert (G.column_sums(x) == want).all()


def task(rng):
    """Fingerprints of tasks of both kinds, in order, and which pairs are compared."""
    base = rng.integers(0, 2**63, (12, 16)).astype(np.uint64)
    prints = []
    for b in base:
        for _ in range(rng.integers(1, 30)):
            flips = np.zeros(1024, np.uint8)
            flips[rng.choice(1024, rng.integers(0, 260), replace=False)] = 1
            prints.append(b ^ np.packbits(flips, bitorder="little").view(np.uint64))
    prints = np.array(prints)[rng.permutation(len(prints))]
    group = np.sort(rng.integers(0, 4, len(prints)))
    own = np.where(group % 2, rng.integers(0, 2, len(prints)), -1)
    own = own[np.lexsort((own, group))]
    return prints, group, own, [(i, j) for j in range(len(prints)) for i in range(j) if group[i] == group[j] and (own[i] < 0 or own[i] != own[j])]


def test_candidates_match_popcounts():
    rng = np.random.default_rng(3)
    prints, group, own, pairs = task(rng)
    size = rng.integers(70, 90, len(prints)).astype(float)
    distance = lambda i, j: np.array([np.bitwise_count(prints[i] ^ prints[j]).sum()])
    want = {(i, j) for i, j in pairs if G.similarity_of(distance(i, j), size[[i]], size[[j]])[0] >= 0.8 - G.SLACK and distance(i, j)[0] <= G.radius_for(0.8 - G.SLACK)}
    got = [p for x, y, _ in G.candidates(group, own, prints, size, 0.8) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert {p for x, y in B.near_pairs(group, own, prints, None, 5) for p in zip(x.tolist(), y.tolist(), strict=True)} == set(pairs)


def test_similarity_of_sets(monkeypatch):
    monkeypatch.setattr(G, "ELEMENTS", 300)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 120))).astype(np.uint32) for _ in range(60)]
    packed = pa.array([b"skipped", *(s.tobytes() for s in sets)], pa.binary()).slice(1)
    x, y = rng.integers(0, 60, 500), rng.integers(0, 60, 500)
    want = [len(np.intersect1d(sets[i], sets[j])) / max(1, len(np.union1d(sets[i], sets[j]))) for i, j in zip(x, y, strict=True)]
    assert np.allclose(G.Sets(packed).similarity(x, y), want)


@pytest.mark.parametrize(("rows", "leaders"), [(2048, 32), (6, 2), (4, 1)])
def test_classes_against_exact_similarity(spark, monkeypatch, rows, leaders):
    monkeypatch.setattr(B, "BUCKET_ROWS", rows)
    monkeypatch.setattr(B, "LEADERS", leaders)
    texts = family(1) + [None, "", " ", "one two", "ONE  two", "solitary"]
    sets = list(map(shingles, texts))
    sure = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    maybe = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.799]
    least, most = roots(len(texts), sure), roots(len(texts), maybe)
    found, classes = G.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as node", "2 as s", "3 as fp"))
    got = {r.id: r.component_id for r in found.join(classes, "fp").collect()}
    assert len(got) == len(texts) and sum(i != r for i, r in enumerate(least)) > 40
    for i in range(len(texts)):
        assert got[i] == got[least[i]]  # every sure link is found
        assert most[got[i]] == most[i]  # and nothing far apart is joined


def test_keeps_one(spark):
    texts = family(2, 12)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (None, "all alone and without an id"), (None, "ALL alone and without an id"), (700, None), (701, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "4 as size")
    kept = G.keep_one_of_similar(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and ids.count(0) == 1 and ids.count(None) == 1 and 700 in ids and 701 not in ids
    assert G.keep_one_of_similar(df.limit(0)).count() == 0


def test_long_text(spark):
    long = " ".join(f"t{i}" for i in range(60000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert sorted(r.doc_id for r in G.keep_one_of_similar(df).collect()) == [1, 3]


def test_rejected_pairs_are_replaced(spark):
    """Of each family the last text holds with the first alone, at 0.81; 30 others at 0.77 may look nearer."""
    rng, texts, each = random.Random(11), [], 32
    for f in range(40):
        base = [f"f{f}w{i}" for i in range(200)]
        spots = rng.sample(range(1, 39), 34)  # five words apart, so that every change spoils five shingles
        for changed in [[], *([x] for x in spots[:30]), spots[30:]]:
            copy = list(base)
            for at in changed:
                copy[5 * at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    sets = list(map(shingles, texts))
    last = range(each - 1, len(texts), each)
    assert all(jaccard(sets[i], sets[i - each + 1]) > 0.81 and max(jaccard(sets[i], sets[j]) for j in range(i - each + 2, i)) < 0.78 for i in last)
    found, classes = G.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.id: r.component_id for r in found.join(classes, "fp").collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % each for i in range(len(texts))]


def test_short_texts_link(spark):
    """Eight words and the same with one more: four shingles of five, a similarity of exactly 0.8."""
    texts = [" ".join(f"d{d}w{i}" for i in range(n)) for d in range(60) for n in (8, 9)]
    found, classes = G.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.id: r.component_id for r in found.join(classes, "fp").collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_keeps_one_of_each_class_of_an_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    df = spark.createDataFrame([(5, a), (9, a), (5, b), (7, b), (5, c), (3, c), (3, c + " more"), (None, a)], "doc_id long, text string")
    kept = [{tuple(r) for r in G.keep_one_of_similar(df.repartition(n)).collect()} for n in (1, 7)]
    assert kept[0] == kept[1] and kept[0] in [{(5, a), (5, b), (3, x)} for x in (c, c + " more")]


@pytest.mark.parametrize("size", [2048, 16])
def test_columns_with_the_operators_own_names(spark, monkeypatch, size):
    monkeypatch.setattr(B, "BUCKET_ROWS", size)
    texts = family(5, 10)
    names = ["kept_id", "Kept_Key", "kept_fp", "kept_root", "kept_of", "kept_row", "row", "id", "node", "rows"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string").selectExpr("*", *(f"doc_id * {k} as `{c}`" for k, c in enumerate(names)))
    plain, kept = G.keep_one_of_similar(df.select("doc_id", "text")).collect(), G.keep_one_of_similar(df)
    rows = kept.collect()
    assert kept.columns == df.columns and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain)
    assert all(r[c] == r.doc_id * k and r.text == texts[r.doc_id] for r in rows for k, c in enumerate(names))
