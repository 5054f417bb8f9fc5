"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. Sources in code-point order (null last) have repeating base
weights and share a total demand; a source's target stops at a multiple of its
size, and what that frees is shared again by weight until no target is above.

Each source is a stream of its documents in the order of a hash, repeated while
its target lasts. A schedule gives the source's intensity over training time,
piecewise linear; its integral is the cumulative demand, and inverting that at
the word where a document begins gives the document's training position.
Documents are range-sorted by position.

The stream is summed in two levels, over hash cells of a source and inside a
cell, so that a source with any share of the rows is spread over many tasks; so
are the repeats of one row, by count. All of it is decided on a narrow row for
each document, which its text meets in one join. Everything is DataFrame
functions.

Defined cases: null or empty text has size 0 and is taken for 0 words; a null
source is a source; rows that agree in id, source and text take neighbouring
places in the stream, which of them first makes no difference; where all sizes
are 0, so are all targets; an empty table stays empty. The word at which a
target is reached may lie inside a document, which is then taken in part;
``mix`` takes that document whole if at least half of it is due. Columns of the
input are kept, whatever their names: inside, they have others.
"""

from __future__ import annotations

from itertools import pairwise
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.tables import named, shield
from caseweave.plans.durable import broadcast_if_small, cut, scratch
from caseweave.plans.ranks import global_rank

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Intensity over training time 0 to 1, as knots (time, intensity), for each base weight in turn:
#: the heavy sources fade, the middle ones stay, the light ones rise.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
#: Rows of a source in one hash cell, about; and the most bits that name a cell.
CELL_ROWS, CELL_BITS = 4096, 16
HASH_BITS = 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stream_key(id_col: Column, text: Column) -> Column:
    """The hash that orders a stream: MD5 of id and text, in hexadecimal."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat(part(id_col), F.lit(":"), part(text)))


def hash60(key: Column) -> Column:
    """The first 60 bits of a hexadecimal hash, as a long that is never negative."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources(mix_source, mix_source_size, mix_rows)`` with its class, weight and target.

    Rounds of resharing: sources at their limit leave, the rest share what is
    left. A round is one aggregation to three numbers.
    """
    ranked = global_rank(sources, [F.col("mix_source").asc_nulls_last()], "mix_rank")
    kind = (F.col("mix_rank") % len(weights)).cast("int")
    table = cut(ranked.select("mix_source", "mix_source_size", "mix_rows", kind.alias("mix_class"), F.element_at(F.array(*map(F.lit, weights)), kind + 1).alias("mix_weight"), (F.col("mix_source_size") * F.lit(float(most))).alias("mix_limit")))
    total = table.agg(F.sum("mix_source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("mix_limit") <= F.col("mix_weight") * F.lit(level)
        n, fixed, weight = table.agg(F.count_if(full), F.sum(F.when(full, F.col("mix_limit"))), F.sum(F.when(~full, F.col("mix_weight")))).first()
        if n == capped or not weight:
            break
        capped, level = n, (share * total - (fixed or 0.0)) / weight
    return table.withColumn("mix_target", F.least("mix_limit", F.col("mix_weight") * F.lit(float(level)) if weight else F.col("mix_limit")))


SEGMENT = "array<struct<since double, until double, begin double, end double, height double, slope double>>"


def segments(schedule) -> list[tuple[float, ...]]:
    """For each piece of a schedule of area 1: the shares of demand and the times between which it runs, its first intensity and slope."""
    areas = [(b - a) * (x + y) / 2 for (a, x), (b, y) in pairwise(schedule)]
    total, before, out = sum(areas), 0.0, []
    for ((a, x), (b, y)), area in zip(pairwise(schedule), areas, strict=True):
        if area > 0:
            out.append((before / total, before / total + area / total, a, b, x / total, (y - x) / (b - a) / total))
        before += area
    return out


def segments_column(schedules, kind: Column) -> Column:
    """The segments of the schedule of a class, as an array of structs."""
    names = ("since", "until", "begin", "end", "height", "slope")
    each = [F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(names, piece, strict=True))) for piece in segments(s))).cast(SEGMENT) for s in schedules]
    return F.element_at(F.array(*each), kind % len(schedules) + 1)


def inverse(pieces: Column, done: Column) -> Column:
    """The training time by which the share ``done`` of a source's demand has come: inverts the integral of its intensity."""

    def at(p: Column) -> Column:
        q = F.greatest(done - p["since"], F.lit(0.0))
        root = F.sqrt(F.greatest(p["height"] * p["height"] + F.lit(2.0) * p["slope"] * q, F.lit(0.0)))
        return F.least(p["begin"] + F.when(q <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * q / (p["height"] + root)), p["end"])

    return F.coalesce(F.get(F.transform(F.filter(pieces, lambda p: done <= p["until"]), at), F.lit(0)), F.lit(1.0))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_goal (in whole words), mix_class, and mix_start: the word of its source's stream at which the document begins.

    No column of ``docs`` may begin with ``mix_``.
    """
    sized = docs.withColumns({"mix_size": words(F.col(text_col)), "mix_key": stream_key(F.col(id_col), F.col(text_col)), "mix_from": F.col(source_col).cast("string")})
    with scratch() as own:
        # one pass over the texts; sums and places follow from a narrow row for each key
        keyed = cut(sized.groupBy("mix_from", "mix_key").agg(F.count(F.lit(1)).alias("mix_n"), F.max("mix_size").alias("mix_each")))
        whole = F.sum(F.col("mix_each") * F.col("mix_n"))
        fine = cut(keyed.groupBy("mix_from", F.shiftright(hash60(F.col("mix_key")), HASH_BITS - CELL_BITS).alias("mix_fine")).agg(whole.alias("mix_cell_size"), F.sum("mix_n").alias("mix_cell_rows")))
        sources = fine.groupBy(F.col("mix_from").alias("mix_source")).agg(F.sum("mix_cell_size").alias("mix_source_size"), F.sum("mix_cell_rows").alias("mix_rows"))
        table = cut(targets(sources, weights, share, most))
        bits = F.least(F.lit(CELL_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("mix_rows") / CELL_ROWS)))).cast("int")
        table = table.withColumn("mix_bits", bits)
        small = broadcast_if_small(table, table.count())
        of_source = F.col("mix_from").eqNullSafe(F.col("mix_source"))
        cells = cut(fine.join(small, of_source).groupBy("mix_source", F.expr(f"shiftright(mix_fine, {CELL_BITS} - mix_bits)").alias("mix_cell")).agg(F.sum("mix_cell_size").alias("mix_cell_size")))
        up_to = Window.partitionBy("mix_source").orderBy("mix_cell").rowsBetween(Window.unboundedPreceding, -1)
        before = cells.select(F.col("mix_source").alias("mix_s"), F.col("mix_cell").alias("mix_c"), F.coalesce(F.sum("mix_cell_size").over(up_to), F.lit(0)).alias("mix_before"))
        before = broadcast_if_small(before, cells.count())
        joined = keyed.join(small, of_source).withColumn("mix_cell", F.expr(f"shiftright(conv(substring(mix_key, 1, 15), 16, 10) :: bigint, {HASH_BITS} - mix_bits)"))
        inside = Window.partitionBy("mix_source", "mix_cell").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
        placed = joined.withColumn("mix_inside", F.coalesce(F.sum(F.col("mix_each") * F.col("mix_n")).over(inside), F.lit(0)))
        placed = placed.join(before, F.col("mix_source").eqNullSafe(F.col("mix_s")) & (F.col("mix_cell") == F.col("mix_c")))
        placed = own.keep(cut(placed.select(F.col("mix_source").alias("mix_s"), F.col("mix_key").alias("mix_k"), "mix_n", "mix_source_size", "mix_target", (F.col("mix_before") + F.col("mix_inside")).alias("mix_first"), F.round("mix_target").cast("long").alias("mix_goal"), "mix_class")))
    of_key = F.col("mix_from").eqNullSafe(F.col("mix_s")) & (F.col("mix_key") == F.col("mix_k"))
    made = ["mix_size", "mix_source_size", "mix_target", "mix_start", "mix_goal", "mix_class"]
    out = sized.join(placed.filter("mix_n = 1"), of_key).withColumn("mix_start", F.col("mix_first")).select(*docs.columns, *made)
    repeated = placed.filter("mix_n > 1")
    if n := repeated.count():
        out = out.unionByName(lay_out(sized.join(broadcast_if_small(repeated, n), of_key), docs.columns).select(*docs.columns, *made))
    return out


def lay_out(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of repeated keys with mix_start: equal ones are counted, however many, and laid out one after another by count."""
    every = [*columns, "mix_size", "mix_source_size", "mix_target", "mix_goal", "mix_class", "mix_first", "mix_s", "mix_k"]
    counted = cut(rows.groupBy(*every).agg(F.count(F.lit(1)).alias("mix_c")))
    # rows of one key that differ in other columns follow each other
    before = F.coalesce(F.sum("mix_c").over(Window.partitionBy("mix_s", "mix_k").orderBy(F.xxhash64(*columns)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = counted.withColumn("mix_b", before).withColumn("mix_slice", F.explode(F.sequence(F.lit(0), F.floor((F.col("mix_c") - 1) / CELL_ROWS))))
    dealt = dealt.repartition("mix_k", "mix_slice")
    nth = F.explode(F.sequence(F.col("mix_slice") * CELL_ROWS, F.least(F.col("mix_c"), (F.col("mix_slice") + 1) * CELL_ROWS) - 1))
    return dealt.withColumn("mix_nth", nth).withColumn("mix_start", F.col("mix_first") + (F.col("mix_b") + F.col("mix_nth")) * F.col("mix_size"))


def words_of_pass(k: Column) -> Column:
    """Words of the document that pass ``k`` of its source's stream takes."""
    return F.greatest(F.lit(0), F.least(F.col("mix_goal") - F.col("mix_start") - k * F.col("mix_source_size"), F.col("mix_size"))).cast("long")


def position_of_pass(k: Column, schedules=SCHEDULES) -> Column:
    """Training time at which pass ``k`` of the stream comes to the document."""
    done = F.when(F.col("mix_goal") > 0, (F.col("mix_start") + k * F.col("mix_source_size")) / F.col("mix_goal")).otherwise(F.lit(0.0))
    return inverse(segments_column(schedules, F.col("mix_class")), done)


def passes(most: float) -> int:
    return max(1, ceil(most))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = MOST, schedules=SCHEDULES, **more) -> DataFrame:
    """One row for each document, in training order: sizes, target, words taken, and its first position."""
    inner, names, _ = shield(docs)
    rows = assign(inner, names[id_col], names[text_col], names[source_col], most=most, **more)
    taken = sum((words_of_pass(F.lit(k)) for k in range(1, passes(most))), words_of_pass(F.lit(0)))
    rows = rows.select(
        F.col(names[id_col]).alias(id_col),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.round("mix_target", 6).alias("target"),
        taken.alias("taken"),
        F.when(words_of_pass(F.lit(0)) > 0, F.round(position_of_pass(F.lit(0), schedules), 9)).alias("position"),
    )
    order = [F.col("position").asc_nulls_last(), named(id_col).asc_nulls_last()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = MOST, schedules=SCHEDULES, **more) -> DataFrame:
    """The training stream: ``docs`` repeated as often as they are taken, range-sorted by position."""
    inner, names, back = shield(docs)
    rows = assign(inner, names[id_col], names[text_col], names[source_col], most=most, **more)
    # at least half of the document is due, or it is empty and comes once
    due = F.filter(F.sequence(F.lit(0), F.lit(passes(most) - 1)), lambda k: F.when(F.col("mix_size") > 0, 2 * words_of_pass(k) >= F.col("mix_size")).otherwise(k == 0))
    rows = rows.withColumn("mix_pass", F.explode(due)).withColumn("mix_at", position_of_pass(F.col("mix_pass"), schedules))
    order = [F.col("mix_at"), F.col(names[id_col]).asc_nulls_last()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*back)


def oracle_sql() -> str:
    """The report as SQL: one window over each source instead of cells, and the resharing in closed form."""

    def time_of(i: int) -> str:
        cases = []
        for since, until, begin, end, height, slope in segments(SCHEDULES[i]):
            q = f"greatest(done - {since!r}::DOUBLE, 0.0)"
            at = f"{begin!r}::DOUBLE + CASE WHEN {q} <= 0 THEN 0.0 ELSE 2.0::DOUBLE * {q} / ({height!r}::DOUBLE + sqrt(greatest({height!r}::DOUBLE * {height!r}::DOUBLE + 2.0::DOUBLE * {slope!r}::DOUBLE * {q}, 0.0))) END"
            cases.append(f"WHEN done <= {until!r}::DOUBLE THEN least({at}, {end!r}::DOUBLE)")
        return f"CASE {' '.join(cases)} ELSE 1.0 END"

    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w!r}::DOUBLE" for i, w in enumerate(WEIGHTS)) + " END"
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, {weight} AS weight, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class, source_size * {MOST!r}::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i FROM w),
tried AS (  -- with all before source i at their limit, the rest share what is left
  SELECT i, cap, weight,
         ({SHARE!r}::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM o),
level AS (SELECT arg_min(lv, i) AS lv FROM tried WHERE cap >= weight * lv),  -- the first that nobody exceeds
t AS (SELECT source, source_size, class, least(cap, weight * coalesce((SELECT lv FROM level), 1e300)) AS target FROM o),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.class, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, greatest(0, least(goal - start, size)) + greatest(0, least(goal - start - source_size, size)) AS taken,
         CASE WHEN goal > 0 THEN start / goal ELSE 0.0 END AS done
  FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN start < goal AND size > 0 THEN round(CASE class {' '.join(f'WHEN {i} THEN {time_of(i)}' for i in range(3))} END, 9) END AS position
FROM p"""
