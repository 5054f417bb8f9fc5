import random
import re

from pyspark.sql import functions as F

from caseweave.llm import chat as C
from tests.llm.fixtures import SF


def brute(rows):
    """Message by message; rows are (conv_id, turn, role, text) without repeats."""
    mark = re.compile(r"^(?:[ \t]*>)+")
    norm = lambda t: re.sub(r"[^0-9a-zA-Zäöüßéèçñ]+", " ", t.lower()).strip(" ")

    def pieces(t):
        parts = [t, *re.split(r"\n\s*\n", t), *t.split("\n")]
        return {p for p in map(norm, parts) if len(p) >= C.MIN_CHARS}

    parsed = []
    for conv, turn, role, text in rows:
        lines = re.split("\r?\n", text or "")
        level = [len(re.sub("[ \t]", "", m.group())) if (m := mark.match(x)) else 0 for x in lines] + [-1]
        own = "\n".join(x for i, x in enumerate(lines) if level[i] == 0 and not (re.search(C.ANNOUNCES, x) and level[i + 1] > 0)).strip(" ")
        quotes, i = [], 0
        while i < len(lines):
            j = i
            while j < len(lines) and level[j] == level[i]:
                j += 1
            if level[i] > 0:
                quotes.append((level[i], "\n".join(re.sub(C.MARKS + "[ \t]?", "", x) for x in lines[i:j])))
            i = j
        parsed.append((conv, turn, role, own, quotes))
    said = [(conv, turn, pieces(own)) for conv, turn, _, own, _ in parsed]
    parent, linked = {}, {}
    for conv, turn, _, _, quotes in parsed:
        best, n = [], 0
        for level, text in quotes:
            found = []
            for p in pieces(text):
                near = [t for c, t, s in said if c == conv and p in s]
                far = [(c, t) for c, t, s in said if p in s]
                if near and min(near) < turn:
                    found.append((len(p), -conv, -min(near)))
                elif far and min(far)[0] < conv:
                    found.append((len(p), -min(far)[0], -min(far)[1]))
            if found:
                n += 1
                best.append((-level, *max(found)))
        linked[conv, turn] = n
        if best:
            parent[conv, turn] = (-max(best)[2], -max(best)[3])
    out = []
    for conv, turn, role, own, quotes in parsed:
        at, depth = (conv, turn), 0
        while at in parent:
            at, depth = parent[at], depth + 1
        out.append([conv, turn, role, own, at[0], at[1], 0, depth, *parent.get((conv, turn), (None, None)), len(quotes), linked[conv, turn]])
    seen = {}
    for r in sorted(out, key=lambda r: (r[4], r[5], r[0], r[1])):
        r[6] = seen.get(r[4], 0)
        seen[r[4]] = r[6] + 1
    return sorted(map(tuple, out))


def thread():
    rng, rows = random.Random(6), []
    sentence = lambda: " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "é", "x"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 9)))
    for conv in range(12):
        texts = []
        for turn in range(rng.randint(1, 14)):
            own = "\n".join(sentence() if rng.random() < 0.8 else "" for _ in range(rng.randint(1, 4)))
            parts = [own]
            if texts and rng.random() < 0.7:
                source = rng.choice(texts if rng.random() < 0.8 else [r[3] for r in rows])
                quote = "\n".join(("> " if rng.random() < 0.7 else ">") + x if not x.startswith(">") else ">" + x for x in source.split("\n"))
                parts = [*(["On Monday Ann wrote:"] if rng.random() < 0.5 else []), quote, *parts] if rng.random() < 0.7 else [own, quote, sentence()]
            text = "\n".join(parts)
            texts.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    return rows


def test_against_brute_force(spark):
    rows = thread()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash")).withColumn("level", F.lit(1))
    got = sorted(map(tuple, C.conversations(df).collect()))
    want = brute(rows)
    assert sum(r[8] is not None for r in want) > 15 and max(r[7] for r in want) > 2
    assert got == want


def test_long_chain_and_hot_passage(spark):
    rows = [(1, 0, "user", "the very first message")] + [(1, t, "user", f"> {'the very first message' if t == 1 else f'answer number {t - 1} here'}\nanswer number {t} here") for t in range(1, 70)]
    rows += [(2, t, "user", "> the very first message\nsame answer for everybody") for t in range(200)]
    got = sorted(map(tuple, C.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert [r[7] for r in got if r[0] == 1] == list(range(70))
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (None, 2, "user", "nobody said this"), (1, None, "user", "> nobody said this"), (3, 0, "user", "x " * 60000), (3, 1, "user", ">"), (3, 1, "user", ">"), (3, 2, "user", "\r\n> > \n\n")]
    got = C.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows) and all(r.parent_conv is None for r in got)
    assert [r.position for r in got if r.conv_id == 3 and r.turn == 1] == [1, 1]
    assert C.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_table_without_quotes_keeps_its_order(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = C.conversations(df).collect()
    assert len(got) == df.count() and all(r.position == r.turn for r in got)
    C.write_chat(df, f"{tmp_path}/chat")
    assert spark.read.parquet(f"{tmp_path}/chat").count() == len(got)


def test_string_ids(spark):
    """The same conversations under numbers and under strings in the same order."""
    said = "we should meet at the old harbour on monday"
    rows = [(1, 0, "a", said), (1, 1, "b", "no idea\nat all"), (1, 2, "a", f"> {said}\n> no idea\nyes"), (2, 0, "b", f"On monday a wrote:\n> {said}\ngood"), (2, 1, "a", "> good\nindeed it is"), (3, 0, "c", "> indeed it is\nquite so")]
    plain = C.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    named = C.conversations(spark.createDataFrame([(f"c{c}", *r) for c, *r in rows], "conv_id string, turn long, role string, text string")).collect()
    tell = lambda rs, f: sorted((f(r.conv_id), r.turn, r.text, f(r.conversation), r.thread_turn, r.position, r.depth, r.parent_conv is not None and f(r.parent_conv), r.parent_turn, r.linked) for r in rs)
    assert tell(plain, lambda c: f"c{c}") == tell(named, str) and sum(r.linked for r in plain) == 3
