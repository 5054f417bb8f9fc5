"""Chat formatting: quotation linking and reply order.

Lines that begin with ``>`` quote an earlier message, one level for each mark.
Runs of lines of one level are quoted passages. A passage, each of its
paragraphs and each of its lines is normalised (lower-cased letters and digits,
single spaces) and hashed, and so are the texts that messages say themselves;
equal hashes link a quotation to the first message that says it, in the same
conversation before the quoting turn if there is one, else in an earlier
conversation. The best link (lowest quote level, then longest passage) names
the message that is answered. Threads are followed to their first message by
pointer doubling, and messages of a conversation are ordered thread by thread
with every reply after what it answers, their texts without quotes.

Everything is DataFrame functions. Hot passages, messages and conversations are
reduced to one row (the first) before they meet a join, and ranks come from
range partitions, so no task holds a group.

Defined cases: null and empty texts say nothing and quote nothing; passages of
under MIN_CHARS normalised characters are removed but not linked; repeated rows
share a position; messages with one (conv_id, turn) and other texts follow each
other; a message never answers itself or a later one; conversations and turns
are ordered as their type is, so string ids go by code point; columns of the
input other than the four are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.plans.durable import broadcast_if_small, cut
from caseweave.plans.ranks import global_rank

MARKS = r"^(?:[ \t]*>)+"
#: A line that announces a quotation, dropped if one follows.
ANNOUNCES = r"^\s*(On|Am|Le|El)\s.*(wrote|schrieb.*|a écrit|escribió)\s*:\s*$"
MIN_CHARS = 8


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[ \t]", ""))


def bare(line: Column) -> Column:
    return F.regexp_replace(line, MARKS + r"[ \t]?", "")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` with qt_key (a hash of the row), qt_own (own text) and qt_quotes: array<struct<level, text>>."""
    flag = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = messages.select(
        F.col("conv_id"), F.col("turn"), F.col("role"), F.md5(F.concat_ws("\1", flag("conv_id"), flag("turn"), flag("role"), flag("text"))).alias("qt_key"),
        F.split(F.coalesce("text", F.lit("")), "\r?\n").alias("qt_lines"),
    )
    rows = rows.withColumn("qt_levels", F.transform("qt_lines", level_of))
    level = lambda i: F.coalesce(F.get("qt_levels", i), F.lit(-1))
    every = F.sequence(F.lit(0), F.size("qt_lines") - 1)
    said = F.filter(every, lambda i: (level(i) == 0) & ~(F.get("qt_lines", i).rlike(ANNOUNCES) & (level(i + 1) > 0)))
    # runs of one level begin where the level changes
    rows = rows.withColumn("qt_starts", F.filter(every, lambda i: level(i) != level(i - 1))).withColumn("qt_own", F.trim(F.array_join(F.transform(said, lambda i: F.get("qt_lines", i)), "\n")))
    runs = F.transform("qt_starts", lambda s, j: F.struct(level(s).alias("level"), F.array_join(F.transform(F.slice("qt_lines", s + 1, F.coalesce(F.get("qt_starts", j + 1), F.size("qt_lines")) - s), bare), "\n").alias("text")))
    return rows.withColumn("qt_quotes", F.filter(runs, lambda r: r["level"] > 0)).drop("qt_lines", "qt_levels", "qt_starts")


def pieces(text: Column) -> Column:
    """Normalised whole, paragraphs and lines of a text that are long enough to be known again."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    return F.array_distinct(F.filter(F.transform(parts, normal), lambda p: F.length(p) >= MIN_CHARS))


def digest(piece: Column) -> Column:
    return F.unhex(F.md5(piece))


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(qt_key, conv_id, turn, n, level, chars, parent_conv, parent_turn): the best link of every quoted passage that has one."""
    quoted = parsed.filter(F.size("qt_quotes") > 0).dropDuplicates(["qt_key"]).select("qt_key", "conv_id", "turn", F.posexplode("qt_quotes").alias("n", "q"))
    asked = cut(quoted.select("qt_key", "conv_id", "turn", "n", "q.level", F.explode(pieces(F.col("q.text"))).alias("p")).select("qt_key", "conv_id", "turn", "n", "level", F.length("p").alias("chars"), digest(F.col("p")).alias("h")))
    wanted = cut(asked.select("h").distinct())
    said = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"), F.explode(F.transform(pieces(F.col("qt_own")), digest)).alias("h"))
    said = cut(said.join(broadcast_if_small(wanted, wanted.count()), "h", "left_semi").groupBy("h", "parent_conv").agg(F.min("parent_turn").alias("parent_turn")))
    near = said.select("h", F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("near_turn"))
    far = said.groupBy("h").agg(F.min(F.struct("parent_conv", "parent_turn")).alias("far"))
    found = asked.join(near, ["h", "conv_id"], "left").join(far, "h", "left")
    same, other = F.col("near_turn") < F.col("turn"), F.col("far.parent_conv") < F.col("conv_id")
    found = found.withColumn("parent", F.when(same, F.struct(F.col("conv_id").alias("parent_conv"), F.col("near_turn").alias("parent_turn"))).when(other, F.col("far"))).filter("parent is not null")
    best = F.min_by("parent", F.struct(-F.col("chars"), "parent"))
    return found.groupBy("qt_key", "conv_id", "turn", "n", "level").agg(best.alias("parent"), F.max("chars").alias("chars")).select("qt_key", "conv_id", "turn", "n", "level", "chars", "parent.*")


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of every message that answers one, by pointer doubling."""
    up = replies.select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = cut(up)
        above = up.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("next_conv"), F.col("root_turn").alias("next_turn"), F.col("depth").alias("more"))
        if up.join(above, ["root_conv", "root_turn"], "left_semi").isEmpty():
            return up
        up = up.join(above, ["root_conv", "root_turn"], "left").select("conv_id", "turn", F.when(F.col("more").isNull(), F.col("root_conv")).otherwise(F.col("next_conv")).alias("root_conv"), F.when(F.col("more").isNull(), F.col("root_turn")).otherwise(F.col("next_turn")).alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row for each message (conv_id, turn, role, text), its text without quotes.

    conversation and thread_turn name the first message of its thread; position
    is its place in the reply-ordered conversation, depth the number of
    messages it answers in a chain, and (parent_conv, parent_turn) the one it answers.
    """
    parsed = parse(messages)
    links = cut(link_quotes(parsed))
    answer = F.min_by(F.struct("parent_conv", "parent_turn"), F.struct("level", -F.col("chars"), "parent_conv", "parent_turn"))
    by_row = links.groupBy("qt_key").agg(answer.alias("qt_parent"), F.countDistinct("n").alias("qt_linked"))
    by_turn = cut(links.groupBy("conv_id", "turn").agg(answer.alias("p")).select("conv_id", "turn", "p.*"))
    roots = threads(by_turn)
    keys = parsed.select("qt_key", "conv_id", "turn").distinct().join(roots, ["conv_id", "turn"], "left")
    keys = keys.select("qt_key", F.coalesce("root_conv", "conv_id").alias("conversation"), F.coalesce("root_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "conv_id", "turn").join(by_row, "qt_key", "left")
    order = [F.col(c).asc_nulls_last() for c in ("conversation", "thread_turn", "conv_id", "turn", "qt_key")]
    ranked = cut(global_rank(keys, order, "qt_rank").drop("conv_id", "turn"))
    first = ranked.groupBy(F.col("conversation").alias("qt_conversation")).agg(F.min("qt_rank").alias("qt_first"))
    placed = ranked.join(first, F.col("conversation").eqNullSafe(F.col("qt_conversation"))).select("qt_key", "conversation", "thread_turn", (F.col("qt_rank") - F.col("qt_first")).alias("position"), "depth", "qt_parent", "qt_linked")
    return parsed.join(broadcast_if_small(placed, ranked.count()), "qt_key").select(
        "conv_id", "turn", "role", F.col("qt_own").alias("text"), "conversation", "thread_turn", "position", "depth", F.col("qt_parent.parent_conv").alias("parent_conv"), F.col("qt_parent.parent_turn").alias("parent_turn"),
        F.size("qt_quotes").alias("quotes"), F.coalesce("qt_linked", F.lit(0)).alias("linked"),
    )


def format_turn(role: Column, text: Column) -> Column:
    """A message in chat markup."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def write_chat(messages: DataFrame, path: str) -> None:
    """The reply-ordered conversations as range-sorted text in Parquet, a message in a row."""
    order = [F.col("conversation").asc_nulls_last(), F.col("position")]
    rows = conversations(messages).withColumn("formatted", format_turn(F.col("role"), F.col("text")))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conversation", "position", "formatted").write.parquet(path)
