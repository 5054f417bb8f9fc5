import random
import re
import zlib
from math import exp, log1p

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import quality as Q
from tests.llm.fixtures import documents, labels


def test_column_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((800, len(Q.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] < 0.7) | (rng.random(800) < 0.05)).astype(float)
    model = Q.fit_rules(x, y)
    assert 0 < len(model.rules) < 200
    assert ((model.scores(x) > 0.5) == y).mean() > 0.93
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(Q.STATISTICS)).select(F.struct(*Q.STATISTICS).alias("s"))
    got = np.array([r[0] for r in df.select(model.column(F.col("s"))).collect()])
    assert np.allclose(got, model.scores(x))


def test_lasso_is_sparse_and_stationary():
    rng = np.random.default_rng(2)
    r = (rng.random((500, 30)) < 0.4).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * r[:, 0] - 2 * r[:, 1])))).astype(float)
    b, w = Q.lasso(r, y, 0.02, steps=3000)
    g = r.T @ (1 / (1 + np.exp(-(b + r @ w))) - y) / len(y)
    assert np.all(np.abs(g[w == 0]) <= 0.02 + 1e-4) and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)
    assert w[0] > 0 > w[1] and (w == 0).sum() > 10


def test_held_out_accuracy(spark):
    docs, known = documents(spark), labels(spark)
    model = Q.learn(docs, known)
    rows = Q.score(docs, model).join(known, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r.predicted == r.quality for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.9


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x " * 200000), (4, "a"), (4, "a"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit(1)).withColumn("q_label", F.lit(2)).withColumn("score", F.lit("clash"))
    none = Q.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in Q.score(docs, none).collect()} == {0.5}
    one = Q.learn(docs, spark.createDataFrame([(1, 1), (4, 1), (4, 1), (3, None)], "doc_id long, quality int"))
    assert Q.score(docs, one).count() == len(rows) and one.rules == []
    assert Q.score(docs.limit(0), none).count() == 0
    assert Q.statistics_of(b"") == (0.0,) * len(Q.STATISTICS)


def naive_statistics(text):
    """The statistics by their names, character by character."""
    if not text:
        return [0.0] * len(Q.STATISTICS)
    words, lines = re.split(r"[ \t\n\r\x0b\x0c]+", text), text.split("\n")
    words = [w.encode() for w in words if w]
    w = max(1, len(words))
    letters = max(1, sum(c.isascii() and c.isalpha() or not c.isascii() for c in text))
    ascii_of = lambda chars: sum(c in chars for c in text)
    shown = sum(c not in " \t\n\r\x0b\x0c" and (not c.isascii() or c.isalnum() or c in ".,|!#$%&*+/<=>@\\^_`~{}[] ") for c in text) + ascii_of(" \t\n\r\x0b\x0c")
    return [
        log1p(len(words)), sum(map(len, words)) / w, sum(c.isascii() and c.isupper() for c in text) / letters, sum(c in "0123456789" for c in text) / max(1, shown), ascii_of("#$%&*+/<=>@\\^_`~{}[]") / max(1, shown),
        ascii_of(".,") / w, ascii_of("|") / w, ascii_of("!") / w, len(set(words)) / w, sum(len(x) <= 3 for x in words) / w, 1 - len(set(lines)) / len(lines), len(words) / len(lines), log1p(max(map(len, words), default=0)), sum(not c.isascii() for c in text) / letters,
    ]


def test_statistics_against_naive_ones():
    rng = random.Random(2)
    texts = ["", "One, two. THREE!", "a\nb\na\n", "é😀 ñ", "  ", "x" * 3000, "1|2|3 #$ {}"] + ["".join(rng.choice("abCD é1.|!#\n") for _ in range(rng.randint(1, 200))) for _ in range(50)]
    for text in texts:
        assert Q.statistics_of(text.encode()) == pytest.approx(naive_statistics(text)), text


def sample(n=400):
    rng = np.random.default_rng(9)
    x = np.c_[rng.integers(0, 12, n), rng.normal(size=n).round(1), rng.integers(0, 3, n)].astype(float)
    return x, ((x[:, 0] > 6) & (x[:, 1] < 0.4) | (rng.random(n) < 0.1)).astype(float)


def test_a_split_is_the_best_of_all():
    x, y = sample()
    edges = [np.unique(c)[:-1] for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    p = np.full(len(y), y.mean())
    g, h, rules, value = p - y, p * (1 - p), set(), np.zeros(len(y))
    Q.grow(binned, edges, g, h, np.arange(len(y)), 1, {}, rules, value)
    gain = {}
    for f in range(3):
        for bound in edges[f]:
            left = x[:, f] <= bound
            if min(left.sum(), (~left).sum()) >= Q.LEAF:
                gain[f, bound] = sum(g[part].sum() ** 2 / (h[part].sum() + 1) for part in (left, ~left))
    f, bound = max(gain, key=gain.get)
    assert rules == {((f, -np.inf, bound),), ((f, bound, np.inf),)}
    for part in (x[:, f] <= bound, x[:, f] > bound):
        assert value[part] == pytest.approx(-g[part].sum() / (h[part].sum() + 1))


def test_lasso_is_at_its_optimum():
    x, y = sample()
    rules = Q.tree_rules(x, y)
    r, strength = Q.holds(rules, x), 0.01
    b, w = Q.lasso(r, y, strength, steps=6000)
    p = np.array([1 / (1 + exp(-(b + sum(c * v for c, v in zip(w, row, strict=True))))) for row in r])
    slope = r.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-3 and (abs(slope) <= strength + 1e-3).all() and 0 < (w != 0).sum() < len(w)
    assert slope[np.abs(w) > 1e-3] == pytest.approx(-strength * np.sign(w[np.abs(w) > 1e-3]), abs=1e-3)


def test_scores_against_rules_read_one_by_one(spark):
    """Whole scores of texts: naive statistics, every rule of the model by hand, the logistic function."""
    model = Q.learn(documents(spark), labels(spark))
    rows = documents(spark).limit(60).collect()
    got = {r.doc_id: (r.score, r.predicted) for r in Q.score(documents(spark), model).collect()}
    for row in rows:
        s, total = naive_statistics(row.text or ""), model.intercept
        for rule, weight in zip(model.rules, model.weights, strict=True):
            if all(low < s[f] <= high for f, low, high in rule):
                total += weight
        score = 1 / (1 + exp(-total))
        assert got[row.doc_id][0] == pytest.approx(score, abs=1e-6) and got[row.doc_id][1] == int(got[row.doc_id][0] >= 0.7)
