"""Average paths around events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_code


def complete(triggers: DataFrame, panel: DataFrame, before: int, after: int) -> DataFrame:
    """Triggers whose whole window lies in the panel and whose close is known and not 0, with it as base."""
    ends = panel.agg(F.max("t").alias("last"))
    inside = triggers.join(F.broadcast(ends)).filter((F.col("t") >= before) & (F.col("t") <= F.col("last") - after)).drop("last")
    base = panel.select("date", "code", F.col("close").alias("base")).filter("base is not null and base <> 0")
    return inside.join(base, ["date", "code"])


def relative(panel: DataFrame, before: int, after: int) -> DataFrame:
    """(date, code, path): of every cell with a known close other than 0 the closes from before rows earlier to after rows
    later, relative to it. One sort of the panel gives all offsets."""
    close, w = F.col("close"), by_code()
    at = [F.lag(close, -k).over(w) if k < 0 else F.lead(close, k).over(w) if k else close for k in range(-before, after + 1)]
    path = F.array(*[x / close - 1 for x in at])
    known = close.isNotNull() & (close != 0)
    return panel.select("date", "code", F.when(known, path).alias("path")).filter("path is not null")


def _offsets(df: DataFrame, before: int, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("path").alias("k", "value")).select(*keys, (F.col("k") - before).cast("int").alias("offset"), "value")


def _event_paths(triggers: DataFrame, panel: DataFrame, cells: DataFrame, before: int, after: int) -> DataFrame:
    own = complete(triggers, panel, before, after).select("event", "date", "code").join(cells, ["date", "code"])
    return _offsets(own, before, "event", "date", "code")


def event_paths(triggers: DataFrame, panel: DataFrame, before: int = 10, after: int = 20) -> DataFrame:
    """(event, date, code, offset, value), null where the close is missing."""
    return _event_paths(triggers, panel, relative(panel, before, after), before, after)


def _controls(triggers: DataFrame, panel: DataFrame, cells: DataFrame, before: int, after: int) -> DataFrame:
    dates = complete(triggers, panel, before, after).select("event", "date").distinct()
    # totals of each date, once for all events, less the event's own cells
    size = before + after + 1
    here = cells.join(dates.select("date").distinct(), "date", "left_semi")
    sums = [F.sum(F.get("path", F.lit(k))).alias(f"s{k}") for k in range(size)] + [F.count(F.get("path", F.lit(k))).alias(f"n{k}") for k in range(size)]
    total = here.groupBy("date").agg(*sums, F.count("*").alias("cells"))
    total = total.select("date", "cells", F.posexplode(F.array(*[F.struct(F.col(f"s{k}").alias("s"), F.col(f"n{k}").alias("n")) for k in range(size)])).alias("k", "x"))
    total = total.select("date", "cells", (F.col("k") - before).cast("int").alias("offset"), "x.s", "x.n")
    own = triggers.select("event", "date", "code").distinct().join(dates, ["event", "date"]).join(cells, ["date", "code"])
    mine = _offsets(own, before, "event", "date").groupBy("event", "date", "offset").agg(F.sum("value").alias("ms"), F.count("value").alias("mn"), F.count("*").alias("mcells"))
    x = dates.join(total, "date").join(mine, ["event", "date", "offset"], "left").filter(F.col("cells") > F.coalesce("mcells", F.lit(0)))
    n = F.coalesce("n", F.lit(0)) - F.coalesce("mn", F.lit(0))
    mean = (F.coalesce("s", F.lit(0.0)) - F.coalesce("ms", F.lit(0.0))) / F.nullif(n, F.lit(0))
    return x.select("event", "date", "offset", mean.alias("control_mean"), n.cast("long").alias("control_count"))


def path_controls(triggers: DataFrame, panel: DataFrame, before: int = 10, after: int = 20) -> DataFrame:
    """(event, date, offset, control_mean, control_count): all stocks without the event on that date, by offset."""
    return _controls(triggers, panel, relative(panel, before, after), before, after)


def path_observations(triggers: DataFrame, panel: DataFrame, before: int = 10, after: int = 20) -> DataFrame:
    """Known path values with their controls: event, date, code, offset, value, control_mean, control_count."""
    cells = relative(panel, before, after)
    x = _event_paths(triggers, panel, cells, before, after).join(_controls(triggers, panel, cells, before, after), ["event", "date", "offset"], "left")
    return x.filter("value is not null").select("event", "date", "code", "offset", "value", "control_mean", F.coalesce("control_count", F.lit(0)).alias("control_count"))


def path_summary(observed: DataFrame) -> DataFrame:
    """Per event and offset: mean, median, quartiles, control mean over the events with a value, and excess."""
    q = lambda p: F.percentile("value", F.lit(p))
    s = observed.groupBy("event", "offset").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), F.avg("control_mean").alias("control_mean"))
    return s.withColumn("excess_mean", F.col("mean") - F.col("control_mean"))


def cumulative_event_path(triggers: DataFrame, panel: DataFrame, before: int = 10, after: int = 20) -> DataFrame:
    """The summary of path_observations()."""
    return path_summary(path_observations(triggers, panel, before, after))
