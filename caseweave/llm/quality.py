"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts (shares of character classes, word and line shapes)
feed small boosted trees. Every path of a tree is a conjunction of bounds on
statistics, a rule; an L1-penalised logistic regression over all rules keeps
few of them with a weight each. The fitted ensemble is compiled to one Spark
column expression over the statistics, so scoring runs inside generated code.

Labels, languages, sources and ids are no statistics. Fitting uses a bounded
sample of labelled rows (SAMPLE_ROWS); scoring covers all rows.

Defined cases: null and empty texts have all statistics zero and are scored by
the same rules; without labels of both kinds the score is the share of label 1
(one half with no label at all); repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.arrow import text_udf

#: At most so many labelled rows are fitted, those that come first by a hash of their id.
SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS, RATE, LEAF = 40, 3, 48, 0.3, 20
#: Strengths of the lasso that are tried on a fifth of the sample.
LASSO = (0.03, 0.01, 0.003, 0.001)
CUT = 0.7

STATISTICS = ("words", "word_bytes", "upper", "digit", "symbol", "stop", "bar", "bang", "distinct", "short", "repeated_lines", "line_words", "longest", "wide")
STATS = T.StructType([T.StructField(n, T.DoubleType()) for n in STATISTICS])


def byte_classes() -> np.ndarray:
    """0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 full stop or comma, 6 bar, 7 bang, 8 other symbol, 9 lead byte beyond ASCII."""
    out = np.zeros(256, np.uint8)
    for names, number in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\n\r\x0b\x0c", 4), (".,", 5), ("|", 6), ("!", 7), ("#$%&*+/<=>@\\^_`~{}[]", 8)):
        out[[ord(c) for c in names]] = number
    out[0xC2:0xF5] = 9
    return out


CLASSES = byte_classes()


def statistics_of(text: bytes) -> tuple[float, ...]:
    """The statistics of a UTF-8 text, in the order of STATISTICS."""
    if not text:
        return (0.0,) * len(STATISTICS)
    n = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=10).tolist()
    words, lines = text.split(), text.split(b"\n")
    lengths = list(map(len, words))
    w, chars, letters = max(1, len(words)), sum(n[1:]), max(1, n[1] + n[2] + n[9])
    return (
        log1p(len(words)),
        sum(lengths) / w,
        n[2] / letters,
        n[3] / max(1, chars),
        n[8] / max(1, chars),
        n[5] / w,
        n[6] / w,
        n[7] / w,
        len(set(words)) / w,
        sum(x <= 3 for x in lengths) / w,
        1 - len(set(lines)) / len(lines),
        len(words) / len(lines),
        log1p(max(lengths, default=0)),
        n[9] / letters,
    )


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text column."""

    @text_udf(STATS)
    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics_of(v.as_py() or b"") for v in texts.cast(pa.binary())], np.float64).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=list(STATISTICS))

    return run(text)


# --- trees and their paths ---------------------------------------------------------------------

#: A rule: for each statistic by number, bounds low < x <= high.
Rule = tuple[tuple[int, float, float], ...]


def grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: dict, rules: set, value: np.ndarray) -> None:
    """Grow one tree on gradients ``g`` and curvatures ``h``: adds its paths to ``rules`` and its leaf values to ``value``."""
    best = (1e-6, -1, -1)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * LEAF:
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            size = len(edges[f]) + 1
            left_g, left_h, left_n = (np.cumsum(np.bincount(b, weights=x, minlength=size))[:-1] for x in (g[rows], h[rows], np.ones(len(rows))))
            if not len(left_g):
                continue
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_n < LEAF) | (len(rows) - left_n < LEAF)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
    if best[1] < 0:
        value[rows] = -total_g / (total_h + 1)
        return
    _, f, at = best
    bound = float(edges[f][at])
    low, high = path.get(f, (-np.inf, np.inf))
    for part, own in ((rows[binned[rows, f] <= at], (low, min(high, bound))), (rows[binned[rows, f] > at], (max(low, bound), high))):
        way = path | {f: own}
        rules.add(tuple(sorted((k, a, b) for k, (a, b) in way.items())))
        grow(binned, edges, g, h, part, depth - 1, way, rules, value)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees for labels ``y``."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    rules: set[Rule] = set()
    margin, every = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        value = np.zeros(len(y))
        grow(binned, edges, p - y, p * (1 - p), every, DEPTH, {}, rules, value)
        margin += RATE * value
    return sorted(rules)


def holds(rules: Iterable[Rule], x: np.ndarray) -> np.ndarray:
    """(rows, rules): 1.0 where a rule holds."""
    out = [np.logical_and.reduce([(x[:, f] > low) & (x[:, f] <= high) for f, low, high in rule]) for rule in rules]
    return np.stack(out, axis=1).astype(np.float64) if out else np.zeros((len(x), 0))


def lasso(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradients; the intercept is free."""
    n = len(y)
    a = np.c_[np.ones(n), r]
    lip = 0.25 * np.linalg.norm(a.T @ a / n, 2) + 1e-9
    w = z = np.r_[np.log(y.mean() / (1 - y.mean())), np.zeros(r.shape[1])]
    t = 1.0
    for _ in range(steps):
        new = z - a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / n / lip
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - strength / lip, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    """An intercept, and weighted rules."""

    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, stats: Column) -> Column:
        """The score, from 0 to 1, as an expression over a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            bounds = [stats[STATISTICS[f]] > low for f, low, _ in rule if np.isfinite(low)] + [stats[STATISTICS[f]] <= high for f, _, high in rule if np.isfinite(high)]
            every = bounds[0]
            for b in bounds[1:]:
                every = every & b
            total = total + F.when(every, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy."""
        return 1 / (1 + np.exp(-(self.intercept + holds(self.rules, x) @ np.array(self.weights))))


def loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules of all rows; the strength of the lasso is the best on every fifth row."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleModel(float(np.log(share / (1 - share))))
    test = np.arange(len(y)) % 5 == 4
    if 0 < y[~test].mean() < 1 and test.any():
        rules = tree_rules(x[~test], y[~test])
        r = holds(rules, x)
        tried = []
        for s in LASSO:
            b, w = lasso(r[~test], y[~test], s)
            tried.append((loss(1 / (1 + np.exp(-(b + r[test] @ w))), y[test]), s))
        strength = min(tried)[1]
    else:
        strength = LASSO[0]
    rules = tree_rules(x, y)
    b, w = lasso(holds(rules, x), y, strength)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(b, [rules[i] for i in kept], [float(w[i]) for i in kept])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def usable(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 != 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """The rules for ``label_col``, from usable labelled rows; at most SAMPLE_ROWS of them reach the driver."""
    label = F.col(label_col).cast("double")
    known = labels.filter(usable(F.col(id_col)) & label.isin(0.0, 1.0)).select(F.col(id_col).alias("q_id"), label.alias("q_label"), F.xxhash64(F.col(id_col).cast("string"), F.lit("quality")).alias("q_hash"))
    first = known.orderBy("q_hash", "q_label").limit(SAMPLE_ROWS).groupBy("q_id", "q_hash").agg(F.min("q_label").alias("q_label"))
    found = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text")).join(F.broadcast(first), F.col("d_id") == F.col("q_id"))
    rows = found.select("q_hash", "q_label", statistics(F.col("d_text")).alias("s")).groupBy("q_hash").agg(F.min(F.struct("s", "q_label")).alias("r")).select("q_hash", "r.q_label", "r.s.*").toPandas().sort_values("q_hash")
    return fit_rules(rows[list(STATISTICS)].to_numpy(np.float64), rows["q_label"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    stats = docs.select(F.col(id_col), statistics(F.col(text_col)).alias("s"))
    scored = stats.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), model.column(F.col("s")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
