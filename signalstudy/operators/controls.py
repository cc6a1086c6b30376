"""Control groups: what the labels were where no event was. Statistics are aggregated once per group and then joined to
the sparse triggers, so non-event cells never meet event cells row by row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank
from ..sources.store import written

MODES = ("same_date", "same_date_style", "unconditional", "event_stock_history")


def style_buckets(panel: DataFrame, style: str, bins: int = 5) -> DataFrame:
    """(date, code, bucket): the date's percentile rank of the style, in bins; null stays null."""
    pct = average_rank(F.col(style), "date")
    return panel.select("date", "code", F.when(F.col(style).isNotNull(), F.least(F.greatest(F.ceil(pct * bins), F.lit(1)), F.lit(bins))).cast("int").alias("bucket"))


def _stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("value").alias("control_mean"), F.median("value").alias("control_median"), F.count("value").alias("control_count"))


def _non_event(labels: DataFrame, triggers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Known labels of each event's dates, at cells where that event is not."""
    dates = triggers.select("event", "date").distinct()
    cells = labels.filter("value is not null").join(dates, "date")
    return cells.join(triggers.select("event", "date", "code"), ["event", "date", "code"], "left_anti").select("event", "date", "code", "label", "value", *keep)


def same_date(labels: DataFrame, triggers: DataFrame) -> DataFrame:
    return _stats(_non_event(labels, triggers), ["event", "label", "date"])


def same_date_style(labels: DataFrame, triggers: DataFrame, buckets: DataFrame) -> DataFrame:
    return _stats(_non_event(labels, triggers).join(buckets.filter("bucket is not null"), ["date", "code"]), ["event", "label", "date", "bucket"])


def unconditional(labels: DataFrame, triggers: DataFrame) -> DataFrame:
    """Over the whole sample: one row per event and label.

    Totals of all cells are taken once, and each event's own cells subtracted. Medians come from counts of distinct values in a
    range sort: offsets of its partitions tell in which the middle ranks of an event lie, and only these are looked into.
    """
    known = labels.filter("value is not null")
    values = known.groupBy("label", "value").agg(F.count("*").alias("n")).repartitionByRange("label", "value")
    values = written(values.withColumn("part", F.spark_partition_id()), "control-values")
    own = known.join(triggers.select("event", "date", "code").distinct(), ["date", "code"]).groupBy("event", "label", "value").agg(F.count("*").alias("m"))
    own = own.join(values.select("label", "value", "part"), ["label", "value"])
    count = lambda c: F.coalesce(c, F.lit(0))
    every = values.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("total"))
    mine = own.groupBy("event", "label").agg(F.sum("m").alias("m"), F.sum(F.col("value") * F.col("m")).alias("own_total"))
    names = triggers.agg(F.collect_set("event").alias("events"))  # one row
    stat = every.join(F.broadcast(names)).select(F.explode("events").alias("event"), "label", "n", "total").join(mine, ["event", "label"], "left")
    stat = stat.withColumn("left", F.col("n") - count("m")).filter(F.col("left") > 0)
    stat = stat.select("event", "label", ((F.col("total") - F.coalesce("own_total", F.lit(0.0))) / F.col("left")).alias("control_mean"), F.col("left").alias("control_count"))
    # which partitions hold the middle ranks, from 0, of what an event leaves
    sizes = values.groupBy("label", "part").agg(F.sum("n").alias("n")).join(stat.select("event", "label", "control_count"), "label")
    sizes = sizes.join(own.groupBy("event", "label", "part").agg(F.sum("m").alias("m")), ["event", "label", "part"], "left").withColumn("k", F.col("n") - count("m"))
    upto = F.sum("k").over(Window.partitionBy("event", "label").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    low, high = F.floor((F.col("control_count") - 1) / 2), F.floor(F.col("control_count") / 2)
    hit = sizes.withColumn("upto", upto).filter((F.col("upto") > low) & (F.col("upto") - F.col("k") <= high))
    hit = hit.select("event", "label", "part", "control_count", (F.col("upto") - F.col("k")).alias("before"))
    fine = hit.join(values, ["label", "part"]).join(own.drop("part"), ["event", "label", "value"], "left").withColumn("k", F.col("n") - count("m"))
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("event", "label", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    fine = fine.withColumn("upto", upto)
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("k") <= rank), F.col("value")))
    middle = fine.groupBy("event", "label").agg(((at(low) + at(high)) / 2).alias("control_median"))
    return stat.join(middle, ["event", "label"]).select("event", "label", "control_mean", "control_median", "control_count")


def stock_history(labels: DataFrame, triggers: DataFrame) -> DataFrame:
    """(event, label, date, code) with the stock's label statistics over all its other dates, leave-one-out: the mean from
    sums, the median from the sorted values with the event's own place skipped."""
    known = labels.filter("value is not null")
    per = known.join(triggers.select("code").distinct(), "code", "left_semi").groupBy("code", "label").agg(F.sort_array(F.collect_list("value")).alias("a"), F.sum("value").alias("total"))
    own = triggers.join(labels.select("date", "code", "label", "value"), ["date", "code"])
    x = own.join(per, ["code", "label"], "left")
    known_own = F.col("value").isNotNull()
    n = F.coalesce(F.size("a"), F.lit(0)) - known_own.cast("int")
    p = F.when(known_own, F.array_position("a", F.col("value")) - 1).otherwise(F.size("a"))
    x = x.withColumn("n", n.cast("long")).withColumn("p", p)

    def at(k: Column) -> Column:
        return F.get("a", (k + (k >= F.col("p")).cast("int")).cast("int"))

    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    some = F.col("n") > 0
    mean = (F.coalesce("total", F.lit(0.0)) - F.coalesce("value", F.lit(0.0))) / F.nullif(F.col("n"), F.lit(0))
    return x.select("event", "label", "date", "code", F.when(some, mean).alias("control_mean"), F.when(some, (at(low) + at(high)) / 2).alias("control_median"), F.col("n").alias("control_count"))


def observations(labels: DataFrame, triggers: DataFrame, modes: Sequence[str], buckets: DataFrame | None = None, min_controls: int = 3) -> DataFrame:
    """(event, date, code, label, horizon, event_value, control_mean, control_median, control_count, excess_mean, mode).

    Without style buckets same_date_style gives the same_date numbers; a bucket that is null or holds fewer than
    min_controls controls falls back to them too. Triggers without a label give no row.
    """
    unknown = set(modes) - set(MODES)
    if unknown:
        raise ValueError(f"unknown control modes: {sorted(unknown)}")
    stat = ["control_mean", "control_median", "control_count"]
    own = triggers.select("event", "date", "code").join(labels.filter("value is not null").select("date", "code", "label", "horizon", F.col("value").alias("event_value")), ["date", "code"])
    parts = []
    plain = own.join(same_date(labels, triggers), ["event", "label", "date"], "left")
    for mode in modes:
        if mode == "same_date" or mode == "same_date_style" and buckets is None:
            df = plain
        elif mode == "same_date_style":
            styled = same_date_style(labels, triggers, buckets).select("event", "label", "date", "bucket", *[F.col(c).alias(f"s_{c}") for c in stat])
            df = plain.join(buckets, ["date", "code"], "left").join(styled, ["event", "label", "date", "bucket"], "left")
            enough = F.coalesce(F.col("s_control_count"), F.lit(0)) >= min_controls
            df = df.select(*own.columns, *[F.when(enough, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in stat])
        elif mode == "unconditional":
            df = own.join(unconditional(labels, triggers), ["event", "label"], "left")
        else:
            df = own.join(stock_history(labels, triggers), ["event", "label", "date", "code"], "left")
        parts.append(df.select(*own.columns, "control_mean", "control_median", F.coalesce("control_count", F.lit(0)).alias("control_count"), (F.col("event_value") - F.col("control_mean")).alias("excess_mean"), F.lit(mode).alias("mode")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def residualize(labels: DataFrame, panel: DataFrame, styles: Sequence[str]) -> DataFrame:
    """Labels with each date's least-squares fit on the styles taken off; a date with fewer than styles + 3 complete rows
    keeps its labels, and rows without a style lose theirs there."""
    x = labels.join(panel.select("date", "code", *styles), ["date", "code"], "left")
    if len(styles) == 1:
        s, y = F.col(styles[0]), F.col("value")
        both = s.isNotNull() & y.isNotNull()
        w = Window.partitionBy("label", "date")
        slope = F.coalesce(F.regr_slope(y, s).over(w), F.lit(0.0))
        fit = F.regr_avgy(y, s).over(w) + slope * (s - F.regr_avgx(y, s).over(w))
        enough = F.count(F.when(both, 1)).over(w) >= 4
        return x.select("date", "t", "code", "label", "horizon", F.when(~enough, y).when(both, y - fit).alias("value"))
    need = len(styles) + 3

    def fit_date(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[["value", *styles]].notna().all(axis=1).to_numpy()
        if ok.sum() >= need:
            a = np.c_[np.ones(ok.sum()), pdf.loc[ok, list(styles)].to_numpy(float)]
            y = pdf.loc[ok, "value"].to_numpy(float)
            rest = np.full(len(pdf), np.nan)
            rest[ok] = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
            pdf = pdf.assign(value=rest)
        return pdf[["date", "t", "code", "label", "horizon", "value"]]

    out = x.select("date", "t", "code", "label", "horizon", "value", *styles)
    kinds = ", ".join(f"{c} {labels.schema[c].dataType.simpleString()}" for c in ("date", "t", "code", "label", "horizon", "value"))
    return out.groupBy("label", "date").applyInPandas(fit_date, kinds).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
