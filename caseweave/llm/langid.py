"""Language ID by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of text
labelled with it. A text is cross-parsed by each automaton: from where a phrase
begins it follows the automaton as long as it can (the longest match with the
sample), and the next phrase begins where it gets stuck. A language that
explains a text well needs few phrases. Counts are normalised to bits a symbol,
``phrases * log2(sample length) / symbols``, and the lowest wins. A letter that
others have and a language's sample lacks has to be named: it costs
log2(letters) more, or else small samples would win whatever none of them fits.

Texts are lower-cased letters and single spaces; any other character ends a
phrase. Parsing runs in lockstep over all such clauses of a batch and all
languages at once: the automata of small alphabets are one transition table, so
a step of every clause is a gather; those of large alphabets (Chinese, Japanese,
Korean) are one hash table of the steps that exist. All letters of the samples
are symbols.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
letters outside the learned alphabet are phrases of their own; ties go to the
language that is first by code point; with nothing learned, all is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.arrow import text_udf
from caseweave.llm.tables import fresh, named
from caseweave.plans.durable import cut, scratch

#: Bounds of the learning sample. For each language: texts of fitting length in order of a hash,
#: whole, until there are SAMPLE_SYMBOLS; at most SAMPLE_TEXTS of them. A language without such
#: texts is learned from its others, of which the first TEXT_MOST characters.
SAMPLE_SYMBOLS, SAMPLE_TEXTS, TEXT_LEAST, TEXT_MOST = 30_000, 64, 200, 8_000
#: Bytes of the transition table that is sent to executors; further languages go to the hash table of steps.
TABLE_BYTES = 128 << 20
#: Letters of the transition table; a language that brings more goes to the hash table of steps.
DENSE_LETTERS = 250
#: The golden ratio's fraction, as an odd 64-bit number, and what no key of a step is.
GOLDEN, NO_KEY = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: A phrase ends at the latest after so many symbols of a clause, which bounds a batch's steps.
CLAUSE = 2048
#: Characters that one vectorised parse takes at once.
SLICE = 1_000_000
#: Symbols from which posterior scores get no sharper.
SHARP = 60
#: A text of at least NOISE_LEAST symbols that its best language explains no better than this is noise; unlearned letters are no evidence of it.
NOISE_BITS, NOISE_LEAST = 11.5, 60
#: NOISE_BITS are those of a whole sample; for one of n symbols they are this times log2(n).
NOISE_SHARE = NOISE_BITS / log2(SAMPLE_SYMBOLS)

BREAK, SPACE, OTHER = 0, 1, 2
PHRASES = 29
STATE = (1 << PHRASES) - 1


def symbol_table(letters: list[str]) -> np.ndarray:
    """Symbol of every code point: 0 break, 1 space, 2 a letter that is not learned, then the letters."""
    out = np.zeros(0x110000, np.uint8 if len(letters) + 3 <= 256 else np.int32)
    number = {c: i + 3 for i, c in enumerate(letters)}
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = number.get(low if len(low) == 1 else c, OTHER)
        elif c.isspace():
            out[cp] = SPACE
    return out


def symbols_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each followed by a break, and each symbol's text; spaces single, none beside breaks."""
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    sym = table[raw]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    edge = np.zeros(1, sym.dtype)
    before = np.r_[edge, sym[:-1]]
    keep = (sym != SPACE) | (before > SPACE)
    sym, owner = sym[keep], owner[keep]
    after = np.r_[sym[1:], edge]
    keep = (sym != SPACE) | (after != BREAK)
    return sym[keep], owner[keep]


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text.tolist():
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = cur
    return step


@dataclass
class Model:
    """The automata of all languages.

    Those of ``dense`` are one table over the letters that they use:
    ``steps[state * width + symbol]`` is the next state, with the number of
    phrases that end before it in the bits from PHRASES on; ``narrow`` gives
    those symbols for the symbols of all letters. The steps of the others are
    in ``sparse``. ``foreign`` says by language and symbol which learned letters
    its sample lacks.
    """

    languages: list[str]
    letters: list[str]
    steps: np.ndarray
    roots: np.ndarray
    sizes: np.ndarray
    dense: np.ndarray
    narrow: np.ndarray
    sparse: Sparse | None
    foreign: np.ndarray

    @property
    def symbols(self) -> int:
        return len(self.letters) + 3

    @property
    def width(self) -> int:
        return int(self.narrow.max()) + 1


    def parts(self) -> dict:
        """Plain values that make the model again: executors get no instance of a class of this package."""
        return vars(self) | {"sparse": self.sparse and vars(self.sparse)}

    @classmethod
    def of(cls, parts: dict) -> Model:
        return cls(**parts | {"sparse": parts["sparse"] and Sparse.of(parts["sparse"])})


class Sparse:
    """Steps (state, symbol) -> state by open addressing, and what begins a phrase at each root."""

    @classmethod
    def of(cls, parts: dict) -> Sparse:
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def __init__(self, width: int, roots: list[int], state: np.ndarray, symbol: np.ndarray, to: np.ndarray):
        self.width, self.roots = width, np.array(roots, np.int64)
        self.shift = np.uint64(64 - max(4, (4 * len(state)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, NO_KEY, np.uint64)
        self.to = np.zeros(self.mask + 1, np.uint32)
        key, to = (state * width + symbol).astype(np.uint64), to.astype(np.uint32)
        at = self.slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] == NO_KEY)
            slots, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[slots], self.to[slots] = key[put], to[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, to, at = key[rest], to[rest], (at[rest] + 1) & self.mask
        # where a state has no step: the phrase ends, and the symbol begins the next one at the root
        begin = np.repeat(self.roots[:, None] | 2 << PHRASES, width, axis=1)
        for i, root in enumerate(self.roots):
            own = state == root
            begin[i, symbol[own]] = self.to_of(state[own], symbol[own]).astype(np.int64) | 1 << PHRASES
        self.begin = begin.astype(np.uint32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(GOLDEN)) >> self.shift).astype(np.int64)

    def to_of(self, state: np.ndarray, symbol: np.ndarray, missing: np.ndarray | None = None) -> np.ndarray:
        """The next states; ``missing`` (or 0) where there is no such step."""
        key = (state.astype(np.int64) * self.width + symbol).astype(np.uint64)
        out = np.zeros(len(key), np.uint32) if missing is None else missing.copy()
        at, open_ = self.slot(key), np.arange(len(key))
        while len(open_):
            got = self.keys[at]
            hit = got == key[open_]
            out[open_[hit]] = self.to[at[hit]]
            on = ~hit & (got != NO_KEY)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """(languages, m) next states with phrases, of (languages, m) states and m symbols."""
        missing = np.where(state == self.roots[:, None], self.roots[:, None] | 1 << PHRASES, self.begin[:, symbol]).astype(np.uint32)
        return self.to_of(state.ravel(), np.tile(symbol, len(state)), missing.ravel()).reshape(state.shape)


def build(samples: dict[str, list[str]]) -> Model:
    """The model of whole sample texts by language."""
    own_letters = {lang: {c for c in "".join(samples[lang]).lower() if c.isalpha()} for lang in samples}
    letters = sorted(set().union(*own_letters.values()))
    table, width = symbol_table(letters), len(letters) + 3
    # languages of few letters first, as long as the table's letters suffice
    few, total = set(), 0
    dense = []
    for lang in sorted(samples, key=lambda x: (len(own_letters[x]), x)):
        both, long = few | own_letters[lang], total + sum(map(len, samples[lang]))
        # an automaton has at most two states a symbol
        if len(both) <= DENSE_LETTERS and 8 * (len(both) + 3) * long <= TABLE_BYTES:
            few, total = both, long
            dense.append(lang)
    number = {c: i + 3 for i, c in enumerate(sorted(few))}
    narrow = np.array([BREAK, SPACE, OTHER, *(number.get(c, OTHER) for c in letters)], np.uint8)
    thin = len(few) + 3
    parts, roots, sizes, base = [], [], [], 0
    far, far_roots, far_base = [], [], 0
    foreign = np.ones((len(samples), width), bool)
    foreign[:, : OTHER + 1] = False
    for lang in sorted(samples):
        sym = np.zeros(0, table.dtype)
        for text in samples[lang]:
            sym = np.r_[sym, symbols_of([text], table)[0]]
        foreign[len(sizes), sym] = False
        sizes.append(max(2, len(sym)))
        if lang not in dense:
            states = suffix_automaton(sym)
            roots.append(far_base)
            far_roots.append(far_base)
            far.append(np.array([(far_base + s, c, far_base + to) for s, step in enumerate(states) for c, to in step.items() if c not in (BREAK, OTHER)], np.int64).reshape(-1, 3))
            far_base += len(states)
            continue
        states = suffix_automaton(narrow[sym])
        root = states[0]
        # where a state has no step: the phrase ends, and the symbol begins the next one at the root
        known = {c: base + to for c, to in root.items() if c not in (BREAK, OTHER)}
        stuck = np.array([known[c] | 1 << PHRASES if c in known else base | 2 << PHRASES for c in range(thin)], np.int64)
        own = np.tile(stuck, (len(states), 1))
        own[0] = [known.get(c, base | 1 << PHRASES) for c in range(thin)]
        for s, step in enumerate(states):
            for c, to in step.items():
                if c not in (BREAK, OTHER):
                    own[s, c] = base + to
        parts.append(own.astype(np.uint32).ravel())
        roots.append(base)
        base += len(states)
    if max(base, far_base) > STATE:
        raise ValueError("the samples are too large for the state numbers")
    sparse = Sparse(width, far_roots, *np.concatenate(far).T) if far else None
    return Model(sorted(samples), letters, np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(roots, np.int64), np.array(sizes, np.float64), np.array([x in dense for x in sorted(samples)], bool), narrow, sparse, foreign)


def parse(model: Model, sym: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, by language and text; symbols, by text) of cross-parsing every clause."""
    k, width = len(model.languages), model.width
    inside = sym != BREAK
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    pieces = np.maximum(1, -(-(end - start) // CLAUSE))
    start = np.repeat(start, pieces) + CLAUSE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(np.repeat(end, pieces), start + CLAUSE)
    length = end - start
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    # how many clauses are longer than t, for every t
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    phrases = np.zeros((k, len(start)), np.uint32)
    thin = model.narrow[sym] if model.dense.any() else sym
    for side, at, step in ((model.dense, thin, lambda state, c: model.steps[state.astype(np.int64) * width + c]), (~model.dense, sym, model.sparse)):
        if not side.any():
            continue
        roots = model.roots[side].astype(np.uint32)[:, None]
        state, made = np.repeat(roots, len(start), axis=1), np.zeros((int(side.sum()), len(start)), np.uint32)
        for t, m in enumerate(active.tolist()):
            got = step(state[:, :m], at[start[:m] + t])
            made[:, :m] += got >> np.uint32(PHRASES)
            state[:, :m] = got & np.uint32(STATE)
        phrases[side] = made + (state != roots)
    texts = owner[start]
    by_text = np.stack([np.bincount(texts, weights=phrases[i], minlength=n) for i in range(k)]) if k else np.zeros((0, n))
    return by_text, np.bincount(texts, weights=length, minlength=n)


def identify(model: Model, texts: list[str | None], table: np.ndarray) -> list[tuple[str, float, float, float]]:
    """(language, score, bits a symbol, phrases a symbol without unlearned letters and what they cut short) of every text."""
    out: list[tuple[str, float, float, float]] = []
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to] or "") <= SLICE):
            total += len(texts[to] or "")
            to += 1
        part = [t or "" for t in texts[at:to]]
        sym, owner = symbols_of(part, table)
        letters = np.bincount(owner, weights=sym > SPACE, minlength=len(part))
        phrases, symbols = parse(model, sym, owner, len(part))
        told = np.flatnonzero(model.foreign.any(axis=0)[sym])
        named = np.stack([np.bincount(owner[told], weights=f[sym[told]], minlength=len(part)) for f in model.foreign]) if model.languages else phrases
        bits = (phrases * np.log2(model.sizes)[:, None] + named * log2(model.symbols)) / np.maximum(symbols, 1)
        unlearned = sym == OTHER
        cut_short = unlearned & (np.r_[BREAK, sym[:-1]] != BREAK) & ~np.r_[False, unlearned[:-1]]
        others, cuts = (np.bincount(owner, weights=x, minlength=len(part)) for x in (unlearned, cut_short))
        for i in range(len(part)):
            if not letters[i] or not model.languages:
                out.append(("und", 0.0, 0.0, 0.0))
                continue
            best = int(np.argmin(bits[:, i]))
            odds = np.exp2(-(bits[:, i] - bits[best, i]) * min(symbols[i], SHARP))
            learned = symbols[i] - others[i]
            noise = 0.0 if others[i] and learned < NOISE_LEAST else max(0.0, phrases[best, i] - others[i] - cuts[i]) / max(1, learned)
            out.append((model.languages[best], float(1 / odds.sum()), float(bits[best, i]), float(noise)))
        at = to
    return out


PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("noise", T.DoubleType())])


def language_of(text: Column, model: Model) -> Column:
    """struct(lang, score, bits, noise) of a text column; the model goes to executors as a broadcast of bounded size."""
    from pyspark.sql import SparkSession

    sent, made = SparkSession.active().sparkContext.broadcast(model.parts()), []

    @text_udf(PREDICTED)
    def run(texts: pa.Array) -> pa.Array:
        if not made:
            model = Model.of(sent.value)
            made.extend((model, symbol_table(model.letters)))
        model, table = made
        rows = identify(model, [None if (b := v.as_py()) is None else b.decode("utf-8", "replace") for v in texts.cast(pa.binary())], table)
        lang, *numbers = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], names=PREDICTED.names)

    return run(text)


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of a bounded sample of the rows of ``docs`` that are ``usable`` and labelled.

    The sample is the same for the same rows in any order: for each language the
    texts of TEXT_LEAST to TEXT_MOST characters that come first by a hash of
    their id, or if it has none, its others. Only those (at most SAMPLE_TEXTS
    for each language, and none after SAMPLE_SYMBOLS) reach the driver.
    """
    from pyspark.sql import Window

    rows = docs.filter(usable & named(lang_col).isNotNull()).select(named(lang_col).alias("li_lang"), F.xxhash64(named(id_col).cast("string"), F.lit("langid")).alias("li_hash"), named(text_col).alias("li_text"))
    rows = rows.withColumn("li_length", F.length("li_text")).filter("li_length > 0").withColumn("li_fits", F.col("li_length").between(TEXT_LEAST, TEXT_MOST)).withColumn("li_text", F.substring("li_text", 1, TEXT_MOST))
    by_rank = Window.partitionBy("li_lang", "li_fits").orderBy("li_hash")
    first = rows.select("li_lang", "li_fits", "li_hash", F.least("li_length", F.lit(TEXT_MOST)).alias("li_length")).withColumn("n", F.row_number().over(by_rank)).filter(F.col("n") <= SAMPLE_TEXTS)
    first = first.withColumn("before", F.sum("li_length").over(by_rank.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("before", F.lit(0)) < SAMPLE_SYMBOLS)
    top = first.groupBy("li_lang", "li_fits").agg(F.max("li_hash").alias("top")).groupBy("li_lang").agg(F.max(F.struct("li_fits", "top")).alias("t"))
    found: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    with scratch():
        top = cut(top.select("li_lang", F.col("t.li_fits").alias("li_fits"), F.col("t.top").alias("top")))
        sample = rows.join(F.broadcast(top), ["li_lang", "li_fits"]).filter("li_hash <= top").groupBy("li_lang", "li_hash").agg(F.min("li_text").alias("li_text"))
        for r in sorted(sample.collect(), key=lambda r: (r.li_lang, r.li_hash)):
            if size.get(r.li_lang, 0) < SAMPLE_SYMBOLS:
                found.setdefault(r.li_lang, []).append(r.li_text)
                size[r.li_lang] = size.get(r.li_lang, 0) + len(r.li_text)
    return build(found)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def usable(id_col: Column) -> Column:
    """Rows to learn from; a row without an id is on neither side."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 != 1, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, bits) of every row."""
    out = docs.select(named(id_col).alias("i"), held_out(named(id_col)).alias("held_out"), language_of(named(text_col), model).alias("p"))
    return out.select(F.col("i").alias(id_col), "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.bits").alias("bits"))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without those of no language: ``und``, or long noise that no language explains.

    Columns of the input stay as they are, whatever their names.
    """
    name = fresh(docs, "langid_p")
    judged, p = docs.withColumn(name, language_of(named(text_col), model)), F.col(name)
    noise = (p["noise"] > NOISE_SHARE) & (F.length(named(text_col)) >= NOISE_LEAST)
    return judged.filter((p["lang"] != "und") & ~noise).drop(name)
