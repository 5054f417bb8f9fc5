import random
import zlib

from pyspark.sql import functions as F

from caseweave.llm import langid as L
from tests.llm.fixtures import documents

SAMPLES = {"aa": ["the cat sat on the mat and then the cat ran " * 4], "bb": ["ein hund lief über die straße und der hund bellte " * 4]}


def brute_phrases(sample: list[str], text: str) -> tuple[int, int]:
    """Cross-parsing by substring search in the normalised samples."""
    model = L.build({"x": sample})
    table = L.symbol_table(model.letters)
    train = bytes(L.symbols_of(sample, table)[0])
    sym, _ = L.symbols_of([text], table)
    phrases = n = 0
    for clause in bytes(sym).split(bytes([L.BREAK])):
        for at in range(0, len(clause), L.CLAUSE):
            piece = clause[at : at + L.CLAUSE]
            n += len(piece)
            i = 0
            while i < len(piece):
                j = i
                while j < len(piece) and piece[j] != L.OTHER and piece[i : j + 1] in train:
                    j += 1
                phrases += 1
                i = max(j, i + 1)
    return phrases, n


def test_phrases_match_brute_force():
    rng = random.Random(5)
    texts = ["", "The cat!", "zzz", "ÜBER die Cat, 12 sat", "日本 cat", "the mat " * 900] + ["".join(rng.choice("the catsonmiü. q") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    for sample in SAMPLES.values():
        model = L.build({"x": sample})
        table = L.symbol_table(model.letters)
        sym, owner = L.symbols_of(texts, table)
        phrases, n = L.parse(model, sym, owner, len(texts))
        for i, t in enumerate(texts):
            assert (int(phrases[0, i]), int(n[i])) == brute_phrases(sample, t), t


def test_edges(spark):
    model = L.build(SAMPLES)
    rows = [(1, "The cat sat on the mat."), (2, "Der Hund bellte über"), (3, None), (4, ""), (5, "123 !!"), (6, "猫"), (1, "The cat sat on the mat."), (None, "the cat ran")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p", F.lit(1)).withColumn("langid_p", F.lit(2))
    got = [(r.doc_id, r.lang_pred) for r in L.predict(df, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "aa"), (1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (6, "aa"), (None, "aa")], key=str)
    assert all(0 <= r.score <= 1 for r in L.predict(df, model).collect())
    assert [r.lang_pred for r in L.predict(df, L.build({})).collect()] == ["und"] * len(rows)
    kept = L.keep_identified(df.withColumn("Langid_P_", F.col("doc_id")), model)
    assert kept.columns == [*df.columns, "Langid_P_"]
    assert sorted((r.doc_id or 0, r.text, r.p, r.langid_p, r.Langid_P_ or 0) for r in kept.collect()) == sorted((d or 0, t, 1, 2, d or 0) for d, t in rows if t and d not in (4, 5))
    assert L.predict(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    docs = documents(spark)
    model = L.learn(docs, L.usable(F.col("doc_id")))
    rows = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_learning_ignores_order_and_other_columns(spark):
    docs = documents(spark)
    a = L.learn(docs, L.usable(F.col("doc_id")))
    b = L.learn(docs.orderBy(F.desc("doc_id")).withColumn("li_lang", F.lit("clash")), L.usable(F.col("doc_id")))
    assert a.letters == b.letters and (a.steps == b.steps).all()


def large_alphabets():
    """Texts by language over 900 signs each, half of them shared, in words of two signs; ``small`` has the smallest sample."""
    rng, out = random.Random(8), {"small": ["the cat sat on the mat and then the cat ran " * 3]}
    for lang, first in (("ja", 0x4E00), ("zh", 0x4E00 + 450)):
        words = [chr(first + rng.randrange(900)) + chr(first + rng.randrange(900)) for _ in range(1500)]
        out[lang] = ["".join(rng.choice(words) for _ in range(150)) for _ in range(80)]
    return out


def test_large_alphabets(spark):
    texts = large_alphabets()
    model = L.build({k: v[:60] for k, v in texts.items()})
    assert len(model.letters) > 1000
    rows = [(lang, t) for lang in ("ja", "zh") for t in texts[lang][60:]] + [("small", "the cat sat on the mat")]
    # of unlearned letters, and half of it learned
    kept = [*rows, ("?", "".join(chr(0xAC00 + i * 7) for i in range(200))), ("?", " the cat ran ".join(chr(0xAC00 + i * 7) * 5 for i in range(20)))]
    df = spark.createDataFrame(kept, "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    got = L.predict(df, model).join(df, "doc_id").filter("lang <> '?'").collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got)
    assert L.keep_identified(df, model).count() == len(kept)


def test_phrases_of_large_alphabets_match_brute_force():
    texts = large_alphabets()
    model = L.build({"zh": texts["zh"][:5]})
    table, train = L.symbol_table(model.letters), "\0".join(texts["zh"][:5])
    phrases, _ = L.parse(model, *L.symbols_of(texts["zh"][5:9] + texts["ja"][:2], table), 6)
    for i, t in enumerate(texts["zh"][5:9] + texts["ja"][:2]):
        n = at = 0
        while at < len(t):
            to = at + 1
            while to < len(t) and t[at : to + 1] in train:
                to += 1
            n, at = n + 1, to
        assert phrases[0, i] == n


def test_every_labelled_language_is_learned(spark, monkeypatch):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(70):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)]
        # the first only has short texts, the second only long ones
        n = {0: 10, 1: 1500}.get(i, 60)
        want.append(f"l{i:02d}")
        rows += [(100 * i + j, want[-1], " ".join(rng.choice(words) for _ in range(n))) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = L.learn(df, F.lit(True))
    assert model.languages == want
    assert all(r.lang == r.lang_pred for r in L.predict(df, model).join(df, "doc_id").collect())
    monkeypatch.setattr(L, "TABLE_BYTES", 1 << 16)
    small = L.learn(df, F.lit(True))
    assert (small.sizes == model.sizes).all() and not small.dense.all() and model.dense.any()
    assert sorted(L.predict(df, small).collect()) == sorted(L.predict(df, model).collect())


def test_noise_is_found_by_small_samples(spark):
    letters = [chr(0x400 + i) for i in range(0x50)]
    model = L.build({"aa": ["the cat sat on the mat and then the cat ran " * 8 + " ".join(letters)]})
    rng = random.Random(1)
    df = spark.createDataFrame([("".join(rng.choice(letters[0x30:]) for _ in range(300)),), ("the cat sat on the mat " * 9,)], "text string")
    assert [r.text[:3] for r in L.keep_identified(df, model).collect()] == ["the"]


def test_choice_and_score_against_brute_force():
    """The language of the fewest bits a symbol by substring search, and odds from what it leads by."""
    rng, model = random.Random(7), L.build(SAMPLES)
    table = L.symbol_table(model.letters)
    texts = ["the cat ran", "der Hund", "über die cat und the hund", "q", "ÜÜ the"] + ["".join(rng.choice("the catsonmiü. nd") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    for text, (lang, score, bits, _) in zip(texts, L.identify(model, texts, table), strict=True):
        sym = [c for c in L.symbols_of([text], table)[0].tolist() if c != L.BREAK]
        if not any(c > L.SPACE for c in sym):
            assert (lang, score) == ("und", 0.0)
            continue
        want = []
        for name in sorted(SAMPLES):
            own = set("".join(SAMPLES[name]).lower())
            size = sum(len(L.symbols_of([t], table)[0]) for t in SAMPLES[name])
            named = sum(model.letters[c - 3] not in own for c in sym if c > L.OTHER)
            # substring search over the letters of both samples
            phrases = brute_phrases_over(SAMPLES[name], text, table)
            want.append((phrases * L.log2(size) + named * L.log2(model.symbols)) / len(sym))
        best = min(range(2), key=lambda i: (want[i], i))
        assert lang == sorted(SAMPLES)[best] and abs(bits - want[best]) < 1e-9
        odds = [2 ** (-(b - want[best]) * min(len(sym), L.SHARP)) for b in want]
        assert abs(score - 1 / sum(odds)) < 1e-9


def brute_phrases_over(sample, text, table):
    train, phrases = bytes(L.symbols_of(sample, table)[0]), 0
    for clause in bytes(L.symbols_of([text], table)[0]).split(bytes([L.BREAK])):
        i = 0
        while i < len(clause):
            j = i
            while j < len(clause) and clause[j] != L.OTHER and clause[i : j + 1] in train:
                j += 1
            phrases, i = phrases + 1, max(j, i + 1)
    return phrases
