"""Factor quantile groups and value summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank, finite


def quantile_groups(panel: DataFrame, factor: str, groups: int = 5) -> DataFrame:
    """(date, t, code, group): Q1 to Qn by the percentile rank of the factor in its code's whole history."""
    edges = [float(e) for e in np.linspace(0, 1, groups + 1)]
    x = panel.select("date", "t", "code", average_rank(F.col(factor), "code").alias("pct")).filter("pct is not null")
    group = F.lit(None).cast("string")
    for k in range(groups, 0, -1):
        group = F.when(F.col("pct") <= F.lit(edges[k]), f"Q{k}").otherwise(group)
    return x.select("date", "t", "code", group.alias("group"))


def cvar(df: DataFrame, keys: list[str], value: str = "value", alpha: float = 0.05) -> DataFrame:
    """keys, cvar: mean of the values at or below their interpolated alpha quantile."""
    known = df.select(*keys, finite(F.col(value)).alias("v")).filter("v is not null")
    q = F.percentile("v", F.lit(alpha)).over(Window.partitionBy(*keys))
    return known.withColumn("q", q).groupBy(*keys).agg(F.avg(F.when(F.col("v") <= F.col("q"), F.col("v"))).alias("cvar"))


def summarize_values(df: DataFrame, keys: list[str], value: str = "value", annualization: int = 252) -> DataFrame:
    """count, mean, median, std, sharpe, hit rates and cvar_5 of finite values per key."""
    v = finite(F.col(value))
    std = F.nullif(F.stddev_samp(v), F.lit(0.0))
    out = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), (F.avg(v) / std * F.sqrt(F.lit(float(annualization)))).alias("sharpe"),
        F.avg((v > 0).cast("double")).alias("hit_rate_positive"), F.avg((v < 0).cast("double")).alias("hit_rate_negative"),
    )
    return out.join(cvar(df, keys, value).withColumnRenamed("cvar", "cvar_5"), keys, "left")


def group_label_summary(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label and group: the summary of its labels, the mean of all known labels as control, and the excess."""
    x = groups.join(labels.select("date", "code", "label", "horizon", "value"), ["date", "code"])
    total = labels.filter("value is not null").groupBy("label").agg(F.avg("value").alias("control_mean"))
    s = summarize_values(x, ["label", "horizon", "group"]).join(F.broadcast(total), "label")
    return s.withColumn("excess_mean", F.col("mean") - F.col("control_mean"))
