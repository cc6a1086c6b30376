"""Mixing by a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, linear between knots. Its integral is the source's
share; targets are the shares of all words, held to max_epochs times the source. Running through a source's
documents in hashed order, each document meets a cumulative demand, and inverting the source's integrated
schedule at that demand gives the document's position in training. Documents are range-sorted by position.
All of it is column expressions: no row visits Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, ranked, unwrapped, wrapped

Schedule = Sequence[tuple[float, float]]

#: Schedules of sources in code point order, repeating; their integrals are 5, 2 and 1.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 7.0), (1.0, 3.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0)))

#: Rows of a source that one task puts in order, about.
ORDERED_ROWS = 50_000


def areas(schedule: Schedule) -> list[float]:
    """The integral of the schedule up to each knot."""
    return list(accumulate(((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])), initial=0.0))


def integral(schedule: Schedule) -> float:
    return areas(schedule)[-1]


def invert(schedule: Schedule, share: Column) -> Column:
    """The time by which this share (0 to 1) of the schedule's integral has passed."""
    upto, out = areas(schedule), None
    want = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(upto[-1])
    for k, ((t, w), (t_next, w_next)) in enumerate(zip(schedule, schedule[1:])):
        rest, slope = want - F.lit(upto[k]), (w_next - w) / (t_next - t)
        # w x + slope x^2 / 2 = rest, in the form that holds for a slope of 0 too
        below = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * rest, F.lit(0.0)))
        x = F.least(F.greatest(F.when(below > 0, 2 * rest / below).otherwise(F.lit(0.0)), F.lit(0.0)), F.lit(t_next - t))
        out = F.lit(t) + x if out is None else F.when(want >= F.lit(upto[k]), F.lit(t) + x).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, max_epochs: float = 3.0) -> DataFrame:
    """sources: source, source_size. Adds rank long, weight and target double.

    Sources are ranked by code point, null last, by a range sort; rank k takes schedule k modulo their number. All words
    are shared by weight; a target above max_epochs times its source stops there and the rest is reshared among the
    others. Only sums come to the driver.
    """
    weights = F.array(*[F.lit(float(integral(s))) for s in schedules])
    s = ranked(sources, [F.col("source").isNull(), F.col("source")], "mix-ranks")
    s = cut(s.withColumn("weight", F.element_at(weights, (F.col("rank") % len(schedules) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(max_epochs))), "mix-sources")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    rate, seen = 0.0, -1
    while True:
        above = F.lit(False) if seen < 0 else F.col("weight") * F.lit(rate) > F.col("most")
        r = s.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count(F.when(above, 1)).alias("n")).first()
        if r.n == seen or not r.weight:
            break
        rate, seen = (total - r.most) / r.weight, r.n
    return s.withColumn("target", F.least(F.col("weight") * F.lit(rate), F.col("most"))).drop("most")


def _plan(rows: DataFrame, count: int, kind: str, schedules: Sequence[Schedule], max_epochs: float, seed: int) -> DataFrame:
    """rows (id, source, size, tie and more), with source_size, target, copies and positions."""
    schedules = [tuple((float(t), float(w)) for t, w in s) for s in schedules]
    bits = max(6, ceil(log2(max(count, 1) / ORDERED_ROWS)) if count else 6)
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = rows.withColumn("h", F.xxhash64("id", "tie", F.lit(seed))).withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    per = cut(rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")), f"mix-words-{kind}")
    aims = targets(per.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, max_epochs)
    # words before a document in its source: those before it in its bucket, and those of the buckets before
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = per.withColumn("ahead", before).alias("a").join(aims.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source")))
    ahead = ahead.select("key", "bucket", "ahead", "source_size", "target", "rank")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("h", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", inside).join(ahead, ["key", "bucket"])
    rows = rows.withColumn("at", F.col("inside") + F.col("ahead"))
    turns = range(ceil(max_epochs))
    middle = [F.col("at") + j * F.col("source_size") + F.col("size") / 2 for j in turns]
    rows = rows.withColumn("copies", sum((F.when(m < F.col("target"), 1).otherwise(0) for m in middle), F.lit(0)).cast("int"))

    def position(j: int) -> Column:
        share = (F.col("at") + j * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
        out = invert(schedules[0], share)
        for k in range(1, len(schedules)):
            out = F.when(F.col("rank") % len(schedules) == k, invert(schedules[k], share)).otherwise(out)
        return F.when(F.col("copies") > j, out)

    return rows.withColumn("positions", F.array_compact(F.array(*[position(j) for j in turns])))


def curriculum(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: Sequence[Schedule] = CURRICULUM, max_epochs: float = 3, seed: int = 17) -> DataFrame:
    """One row per row of df: id, source, size long (words; null text 0), source_size long, target double, copies int,
    taken long (size times copies) and positions array<double> (one training time per copy, none if not taken).

    A copy of a document is taken when the middle of its words lies below its source's target, so a source's taken
    words miss the target by half a document at most. The order within a source is a hash of id, text and seed: reruns
    agree. Null sources are one source. A source without words takes nothing; a document without words in another
    is taken like any other and costs nothing. Rows that repeat an id, null ids among them, are planned each for itself.
    An empty table gives no rows; other columns of df are ignored.
    """
    text = col(text_col)
    rows = df.select(col(id_col).alias("id"), col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))
    rows = cut(rows, "mix-sizes")
    out = _plan(rows, rows.count(), "narrow", schedules, max_epochs, seed)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", taken, "positions")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: Sequence[Schedule] = CURRICULUM, max_epochs: float = 3, seed: int = 17) -> DataFrame:
    """df as trained on: every row once per copy that curriculum() gives it, range-sorted by training position. Columns
    as in df, whatever their names.

    Rows travel with their texts, so no plan is joined back by id: rows that repeat an id keep each its own.
    """
    text = col(text_col)
    rows = wrapped(df, id=col(id_col), source=col(source_col), size=word_count(text), tie=F.xxhash64(text))
    out = _plan(rows, df.count(), "whole", schedules, max_epochs, seed)
    out = out.filter("copies > 0").select("row", "id", "tie", F.explode("positions").alias("position"))
    return unwrapped(out.orderBy("position", "id", "tie").select("row"))
