"""Benchmark decontamination: BM25 with block-max WAND, then a check of question and answer.

Test items are cut into units of at most UNIT words, and an inverted index over
the units holds BM25 contributions divided by the unit's own score, so that a
passage with all words of a unit scores about 1. Units are in blocks; for every
term and block the index knows the largest contribution.

Every training text is read as passages of PASSAGE words, each beginning half a
passage after the last, so that each unit lies whole in one of them. A passage
is a query of its distinct words. Block maxima first bound its score in every
block at once (its lightest words, together below LIGHT, count in full for every
block, so that postings of common words are not gone through); passages with a
block above the threshold go through WAND, which moves by pivots, skips blocks
whose maxima can't reach the threshold, and returns all units above it. Items
of those units are then verified where they were found, near the passage.

What is verified is the share of five-word shingles of the item, of its
question and of its answer; a part of under ten words, which one changed word
can spoil, is laid over the text word by word at its best place instead. An
item leaks if at least OVERLAP of it occurs and at least PART of the question
and of the answer each, or OVERLAP of each of them. The question ends with the
first line or question mark; an item of one piece is all question.

The index is arrays, a few bytes for each word of the items. A benchmark above
GROUP_BYTES is run group by group, one pass over the texts for each.

Defined cases: null and empty texts hold no item; items without a word are
never found; repeated items are each reported; without items no text is
contaminated. Matching ignores case and ASCII punctuation. Columns of the input
may have any names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.arrow import text_udf
from caseweave.llm.tables import fresh, named
from caseweave.plans.durable import broadcast_if_small, cut, scratch

UNIT, PASSAGE, SHINGLE = 32, 64, 5
#: Share of a unit's own score from which a passage is a candidate; shares of an item, and of its question and answer, that verify it.
THRESHOLD, OVERLAP, PART = 0.6, 0.8, 0.5
K1, B = 1.2, 0.75
BLOCK = 4
#: Score that the lightest words of a passage may bring together, of half the threshold at most.
LIGHT = 0.15
#: Items are indexed and sent to executors in groups of at most so many bytes; a larger benchmark is run group by group.
GROUP_BYTES = 16 << 20
#: Words whose passages are bounded in one vectorised step, and entries of the index in one.
SLICE, ENTRIES = 200_000, 4_000_000
#: Bytes of a table of marks.
DENSE = 48 << 20

PUNCTUATION = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, punctuation of ASCII taken as space."""
    return (text or "").lower().encode("utf-8", "replace").translate(PUNCTUATION).split()


def parts_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    text = text.strip()
    cuts = [i + 1 for i in (text.find("\n"), text.find("?")) if i >= 0]
    at = min(cuts, default=len(text))
    question, answer = words_of(text[:at]), words_of(text[at:])
    return (question, answer) if question else (answer, [])


class Index:
    """Units in order of item, postings by term, and the words of the items.

    Terms are numbered from 1 by their largest contribution; 0 is a word that no item has. The postings of
    term t are the entries starts[t] to starts[t + 1] of units and scores, its
    block maxima those of block_starts of blocks and bounds.
    """

    FIELDS = ("ids", "vocabulary", "unit_item", "starts", "units", "scores", "most", "block_starts", "blocks", "bounds", "item_starts", "words", "question")

    def __init__(self, parts: tuple) -> None:
        self.ids, vocabulary, *arrays = parts
        self.terms = {w: i for i, w in enumerate(vocabulary.split(b" ") if vocabulary else (), 1)}
        for name, array in zip(self.FIELDS[2:], arrays, strict=True):
            setattr(self, name, array)
        self.unit_at, self.score_at, self.block_at, self.bound_at = map(memoryview, (self.units, self.scores, self.blocks, self.bounds))

    @property
    def n_blocks(self) -> int:
        return -(-len(self.unit_item) // BLOCK)

    def block_bound(self, term: int, block: int) -> float:
        end = int(self.block_starts[term + 1])
        i = bisect_left(self.block_at, block, int(self.block_starts[term]), end)
        return self.bound_at[i] if i < end and self.block_at[i] == block else 0.0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.terms.get
        return np.array([get(w, 0) for w in words], np.int64)

    def item(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of an item, of its question and of its answer."""
        words = self.words[self.item_starts[i] : self.item_starts[i + 1]]
        return words, words[: self.question[i]], words[self.question[i] :]


def index_parts(items: list[tuple[object, str | None]]) -> tuple:
    """What :class:`Index` is made of, as plain values: arrays, ids, and the vocabulary joined by spaces."""
    terms: dict[bytes, int] = {}
    ids, numbered, question = [], [], []
    for i, text in items:
        parts = parts_of(text or "")
        words = [*parts[0], *parts[1]]
        if words:
            ids.append(i)
            question.append(len(parts[0]))
            numbered.append(np.array([terms.setdefault(w, len(terms) + 1) for w in words], np.int32))
    length = np.array([len(w) for w in numbered], np.int64)
    words = np.concatenate(numbered) if numbered else np.zeros(0, np.int32)
    item_starts = np.r_[0, np.cumsum(length)]
    # units of an item: pieces of even length
    pieces = -(-length // UNIT)
    unit_item = np.repeat(np.arange(len(ids), dtype=np.int32), pieces)
    nth = np.arange(len(unit_item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = item_starts[unit_item] + nth * length[unit_item] // pieces[unit_item]
    size = np.diff(np.r_[begin, len(words)])
    n, width = len(unit_item), len(terms) + 1
    key, tf = np.unique(np.repeat(np.arange(n), size) * width + words, return_counts=True)
    unit, term = key // width, key % width
    df = np.bincount(term, minlength=width)[term]
    score = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[unit] / (size.mean() if n else 1)))
    score /= np.bincount(unit, weights=score, minlength=n)[unit]
    # terms are numbered by their largest contribution, the lightest first
    most = np.zeros(width)
    np.maximum.at(most, term, score)
    by_weight = np.argsort(most, kind="stable")  # 0 stays first
    number = np.empty(width, np.int64)
    number[by_weight] = np.arange(width)
    names = list(terms)
    vocabulary = b" ".join(names[t - 1] for t in by_weight[1:].tolist())
    most, term, words = most[by_weight], number[term], number[words].astype(np.int32)
    order = np.lexsort((unit, term))
    unit, term, score = unit[order], term[order], score[order]
    edge = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (unit[1:] // BLOCK != unit[:-1] // BLOCK)][: len(term)])
    bounds = np.maximum.reduceat(score, edge) if len(edge) else score
    every = np.arange(width + 1)
    starts, block_starts = np.searchsorted(term, every), np.searchsorted(term[edge], every)
    return (ids, vocabulary, unit_item, starts, unit.astype(np.int32), score, most, block_starts, (unit[edge] // BLOCK).astype(np.int32), bounds, item_starts, words, np.array(question, np.int64))


def build(items: list[tuple[object, str | None]]) -> Index:
    """The index of (id, text) items."""
    return Index(index_parts(items))


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (unit, score) with a score of at least ``threshold`` for a query of distinct terms."""
    units, scores, most = index.unit_at, index.score_at, index.most
    # (next unit, its entry, end of the entries, term)
    cursors = [[units[a], a, b, t] for t in terms if (a := int(index.starts[t])) < (b := int(index.starts[t + 1]))]
    out: list[tuple[int, float]] = []
    slack = threshold - 1e-9

    def advance(cursor, to: int) -> None:
        at = cursor[1] = bisect_left(units, to, cursor[1], cursor[2])
        cursor[0] = units[at] if at < cursor[2] else -1

    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += most[c[3]]
            if bound >= slack:
                pivot = i
                break
        if pivot < 0:
            break
        unit = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
            pivot += 1
        block = unit // BLOCK
        if sum(index.block_bound(c[3], block) for c in cursors[: pivot + 1]) < slack:
            # nothing in this block can do it with these terms: go to its end, or to where the next term joins
            to = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][0])
            for c in cursors[: pivot + 1]:
                advance(c, max(to, unit + 1))
        elif cursors[0][0] == unit:
            score = sum(scores[c[1]] for c in cursors[: pivot + 1])
            if score >= slack:
                out.append((unit, score))
            for c in cursors[: pivot + 1]:
                advance(c, unit + 1)
        else:
            for c in cursors[:pivot]:
                if c[0] < unit:
                    advance(c, unit)
        cursors = [c for c in cursors if c[0] >= 0]
    return out


def passages(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first passage of each text, passages of each text); passage i of a text begins at word i * PASSAGE / 2."""
    half = PASSAGE // 2
    count = np.array([max(1, -(-n // half) - 1) for n in lengths], np.int64)
    return np.cumsum(count) - count, count


def distinct(keys: np.ndarray, size: int) -> np.ndarray:
    """Distinct keys below ``size`` in order; by marking them where that many fit into memory."""
    if size > DENSE:
        return np.unique(keys)
    marks = np.zeros(size, np.bool_)
    marks[keys] = True
    return np.flatnonzero(marks)


def sums(keys: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys below ``size``, the sums of their values)."""
    if size <= DENSE // 8:
        total = np.bincount(keys, weights=values, minlength=size)
        keys = np.flatnonzero(total)
        return keys, total[keys]
    keys, where = np.unique(keys, return_inverse=True)
    return keys, np.bincount(where, weights=values)


def hopeful(index: Index, window: np.ndarray, term: np.ndarray, n_windows: int, threshold: float) -> np.ndarray:
    """Passages that may score ``threshold`` in a block, of the (passage, term) pairs in order."""
    if not len(window):
        return window
    most = index.most[term]
    total = np.cumsum(most)
    begin = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    before = np.repeat(np.r_[0.0, total][begin], np.diff(np.r_[begin, len(window)]))
    # the lightest words of a passage, as far as together they stay light: terms are numbered so that they come first
    light = total - before <= min(LIGHT, threshold / 2)
    least = threshold - 1e-9 - np.bincount(window[light], weights=most[light], minlength=n_windows)
    window, term = window[~light], term[~light]
    many = index.block_starts[term + 1] - index.block_starts[term]
    ends, out, at = np.cumsum(many), [], 0
    while at < len(window):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right"))
        to = int(np.searchsorted(window, window[to], "left")) if to < len(window) else to
        if to <= at:  # a passage stays whole
            to = int(np.searchsorted(window, window[at], "right"))
        m, low = many[at:to], int(window[at])
        entry = np.repeat(index.block_starts[term[at:to]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        cell = np.repeat((window[at:to] - low) * index.n_blocks, m) + index.blocks[entry]
        keys, bound = sums(cell, index.bounds[entry], (int(window[to - 1]) - low + 1) * index.n_blocks)
        own = low + keys // index.n_blocks
        out.append(np.unique(own[bound >= least[own]]))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def find(index: Index, texts: list[np.ndarray], threshold: float = THRESHOLD) -> list[set[tuple[int, int]]]:
    """For each text, as numbers of its words, the (passage, item) pairs that WAND retrieves."""
    found: list[set[tuple[int, int]]] = [set() for _ in texts]
    if not len(index.unit_item):
        return found
    half = PASSAGE // 2
    first, count = passages(list(map(len, texts)))
    windows, ids = [], []
    for i, t in enumerate(texts):
        at = np.flatnonzero(t)
        block, top = at // half, count[i] - 1
        windows += [first[i] + np.minimum(block, top), first[i] + np.clip(block - 1, 0, top)]
        ids += [t[at], t[at]]
    width, n_windows = len(index.terms) + 1, int(count.sum())
    pairs = distinct(np.concatenate(windows) * width + np.concatenate(ids), n_windows * width) if windows else np.zeros(0, np.int64)
    window, term = pairs // width, pairs % width
    owner = np.repeat(np.arange(len(texts)), count)
    for w in hopeful(index, window, term, n_windows, threshold).tolist():
        a, b = np.searchsorted(window, [w, w + 1])
        i = int(owner[w])
        found[i] |= {(int(w - first[i]), int(index.unit_item[u])) for u, _ in wand(index, term[a:b].tolist(), threshold)}
    return found


def shingles(words: list[int]) -> set[tuple[int, ...]]:
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def share_of(part: np.ndarray, region: np.ndarray, there: set[tuple[int, ...]]) -> float:
    """Share of a part of an item that the region of a text says: of its shingles, or of its words where it has few of them."""
    n = len(part)
    if not n:
        return 1.0
    if n >= 2 * SHINGLE:
        own = shingles(part.tolist())
        return len(own & there) / len(own)
    padded = np.concatenate((np.zeros(n - 1, np.int64), region, np.zeros(n - 1, np.int64)))
    return float((np.lib.stride_tricks.sliding_window_view(padded, n) == part).sum(axis=1).max() / n) if len(padded) >= n else 0.0


def verify(index: Index, words: np.ndarray, hits: set[tuple[int, int]]) -> dict[int, tuple[float, float, float]]:
    """For each item found, its best (overlap, overlap of the question, of the answer) near a passage."""
    out: dict[int, tuple[float, float, float]] = {}
    for passage, item in sorted(hits):
        parts = index.item(item)
        at, more = passage * PASSAGE // 2, len(parts[0])
        region = words[max(0, at - more) : at + PASSAGE + more]
        there = shingles(region.tolist())
        got = tuple(share_of(p, region, there) for p in parts)
        out[item] = max(out.get(item, got), got, key=lambda g: (is_leak(index, item, g), g))
    return out


def is_leak(index: Index, item: int, got: tuple[float, float, float]) -> bool:
    """Whether overlaps of an item, its question and its answer are those of a leak."""
    whole, question, answer = got
    words, _, second = index.item(item)
    split = len(second) > 0 and len(words) >= SHINGLE and min(question, answer) >= OVERLAP
    return split or whole >= OVERLAP and min(question, answer) >= PART


def leaks(index: Index, texts: list[str | None]) -> Iterator[list[tuple[int, float, float, float]]]:
    """For each text, the items that leak: (item number, overlap, of the question, of the answer)."""
    words, total = [], 0

    def judged():
        for w, hits in zip(words, find(index, words), strict=True):
            found = verify(index, w, hits) if hits else {}
            yield [(i, *o) for i, o in sorted(found.items()) if is_leak(index, i, o)]

    for text in texts:
        words.append(index.numbers(words_of(text)))
        total += len(words[-1])
        if total >= SLICE:
            yield from judged()
            words, total = [], 0
    yield from judged()


def leak_column(text: Column, parts: tuple, id_type: T.DataType) -> Column:
    """array<struct<item_id, overlap, question_overlap, answer_overlap>> of a text column."""
    from pyspark.sql import SparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    sent, arrow_id = SparkSession.active().sparkContext.broadcast(parts), to_arrow_type(id_type)
    names, made = ["item_id", "overlap", "question_overlap", "answer_overlap"], {}
    leak = T.StructType([T.StructField(n, T.DoubleType() if i else id_type) for i, n in enumerate(names)])

    @text_udf(T.ArrayType(leak))
    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made[0] = Index(sent.value)
        index = made[0]
        rows = list(leaks(index, [None if (b := v.as_py()) is None else b.decode("utf-8", "replace") for v in texts.cast(pa.binary())]))
        flat = [x for r in rows for x in r]
        columns = [pa.array([index.ids[x[0]] for x in flat], arrow_id), *(pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3))]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32()), pa.StructArray.from_arrays(columns, names=names))

    return run(text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with a new column ``name``: array<struct<item_id, overlap, question_overlap, answer_overlap>>, by item.

    The benchmark is a query set of checked size: it is counted first, and if
    its texts have more than ``group_bytes`` they are dealt by hash over groups.
    All texts are matched against one group after another, each with an index of
    its own; the leaks of a group are few rows, by text, and meet the documents
    at the end.
    """
    items = benchmark.select(named(item_id_col).alias("item_id"), named(item_text_col).alias("item_text"))
    id_type = items.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    groups = -(-size // group_bytes) or 1

    def parts_of_group(g: int) -> tuple:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(groups)) == g).collect()
        return index_parts(sorted(((r.item_id, r.item_text) for r in rows), key=lambda r: (r[0] is None, r[0], r[1] or "")))

    if groups == 1:
        return docs.withColumn(name, leak_column(named(text_col), parts_of_group(0), id_type))
    key, found = F.md5(F.coalesce(named(text_col), F.lit(""))), None
    with scratch() as own:
        for g in range(groups):
            texts = docs.select(key.alias("key"), leak_column(named(text_col), parts_of_group(g), id_type).alias("leaked"))
            texts = texts.filter(F.size("leaked") > 0).groupBy("key").agg(F.first("leaked").alias("leaked"))
            found = cut(texts if found is None else found.union(texts))
        found = own.keep(cut(found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("leaked"))).alias("leaked"))))
    own_key, own_leaks = fresh(docs, "dc_key"), fresh(docs, "dc_leaks")
    few = broadcast_if_small(found.select(F.col("key").alias(own_key), F.col("leaked").alias(own_leaks)), found.count(), 10_000)
    none = F.array().cast(found.schema["leaked"].dataType)
    return docs.join(few, key == F.col(own_key), "left").withColumn(name, F.coalesce(own_leaks, none)).drop(own_key, own_leaks)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: whether it leaks, the items, and the largest overlap."""
    out = with_leaks(docs.select(named(id_col).alias("dc_id"), named(text_col).alias("dc_text")), benchmark, "leaked", "dc_text")
    return out.select(
        F.col("dc_id").alias(id_col),
        (F.size("leaked") > 0).alias("contaminated"),
        F.transform("leaked", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaked", lambda x: x["overlap"])), F.lit(0.0)).alias("overlap"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay as they are, whatever their names."""
    name = fresh(docs, "dc_leaked")
    return with_leaks(docs, benchmark, name, text_col).filter(F.size(name) == 0).drop(name)
