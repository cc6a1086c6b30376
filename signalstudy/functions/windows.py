"""Rolling and ranking expressions on a panel of columns code and t. One window specification is shared, so that
Catalyst plans a single exchange and sort for all expressions of one select."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def by_code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("t")


def rows(first: int, last: int):
    return by_code().rowsBetween(first, last)


def lag(x: Column, k: int) -> Column:
    return F.lag(x, k).over(by_code())


def full(agg: Column, x: Column, first: int, last: int, least: int) -> Column:
    """agg over the frame where it holds at least so many non-null values, else null."""
    w = rows(first, last)
    return F.when(F.count(x).over(w) >= least, agg.over(w))


def rolling_mean(x: Column, window: int) -> Column:
    return full(F.avg(x), x, 1 - window, 0, window)


def prior_high(x: Column, window: int) -> Column:
    """Greatest of the window rows before this one; null unless all are there."""
    return full(F.max(x), x, -window, -1, window)


def change(x: Column, k: int = 1) -> Column:
    """Relative change over k rows; null where the base is 0 or missing."""
    return x / F.nullif(lag(x, k), F.lit(0.0)) - 1


def rolling_zscore(x: Column, window: int = 60) -> Column:
    least = max(5, window // 3)
    return (x - full(F.avg(x), x, 1 - window, 0, least)) / F.nullif(full(F.stddev_pop(x), x, 1 - window, 0, least), F.lit(0.0))


def rolling_percentile(x: Column, window: int = 252) -> Column:
    """Share of the window's non-null values at or below the row's own, ties at the greatest rank."""
    held = F.collect_list(x).over(rows(1 - window, 0))
    return F.when(x.isNotNull() & (F.size(held) >= max(20, window // 4)), F.size(F.filter(held, lambda z: z <= x)) / F.size(held))


def average_rank(x: Column, *by: str) -> Column:
    """Percentile rank of x among the non-null values of its group, ties at their mean rank; null stays null."""
    known = x.isNotNull()
    ranked = Window.partitionBy(*by, known).orderBy(x)
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    n = F.count(x).over(Window.partitionBy(*by, known))
    return F.when(known, (F.rank().over(ranked) + (peers - 1) / 2.0) / n)


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(F.abs(x) < float("inf"), x)
