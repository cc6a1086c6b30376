"""Greedy purge of repeated triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicate(triggers: DataFrame, cooldown_days: int) -> DataFrame:
    """purge() with a checked cooldown: an integer of 0 or more."""
    if type(cooldown_days) is not int:
        raise TypeError("cooldown_days must be an integer")
    if cooldown_days < 0:
        raise ValueError("cooldown_days must not be negative")
    return purge(triggers, cooldown_days)


def purge(triggers: DataFrame, cooldown: int | Column) -> DataFrame:
    """Keep a trigger if it lies more than cooldown rows after the last one kept for its event and code.

    The fold runs over each event and code's sorted positions; a cooldown of 0 or less keeps all.
    """
    gap = F.lit(cooldown) if isinstance(cooldown, int) else cooldown
    one = triggers.withColumn("gap", gap.cast("long"))
    cells = one.groupBy("event", "code").agg(F.array_sort(F.collect_set(F.struct("t", "date"))).alias("cells"), F.max("gap").alias("gap"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.filter("cells", lambda c: F.lit(False)).alias("kept"))

    def step(s: Column, c: Column) -> Column:
        keep = s["last"].isNull() | (F.col("gap") <= 0) | (c["t"] - s["last"] > F.col("gap"))
        return F.struct(F.when(keep, c["t"]).otherwise(s["last"]).alias("last"), F.when(keep, F.concat(s["kept"], F.array(c))).otherwise(s["kept"]).alias("kept"))

    kept = cells.select("event", "code", F.explode(F.aggregate("cells", start, step, lambda s: s["kept"])).alias("c"))
    return kept.select("event", "c.date", "c.t", "code")
