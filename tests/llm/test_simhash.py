import random
import re

import xxhash
from pyspark.sql import functions as F

from caseweave.llm import buckets, simhash

WS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4, classes=False):
    fp = [brute_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                part[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    if classes:
        return ids.values()
    return sorted(((d, f"{fp[i]:016x}", min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    rows = []
    for d in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 400))]
        rows.append((d, " ".join(words)))
        for k in range(rng.randint(0, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((1000 + 100 * d + k, "\t".join(copy)))
    return rows + [(2, None), (2, None), (3, ""), (4, " \n\x0b"), (5, "one"), (5, "one"), (None, "one two"), (None, None), (None, "lonely row without an id"), (9, "x " * 70000)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("id", F.lit(1))
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_hot_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 8)
    monkeypatch.setattr(buckets, "LEADERS", 2)
    rows = corpus()
    got = sorted((tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_keep_one(spark):
    rows = corpus()
    want = [min((i for i in ids if i is not None), default=None) for ids in brute(rows, classes=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("orphan_key", F.lit(0))
    kept = simhash.keep_one_a_class(df, simhash.simhash_classes(df), simhash.fingerprint_column)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in buckets.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
