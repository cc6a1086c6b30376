"""Equal-weight backtests over a grid of holding periods and fees, as one plan: horizons are keys of the daily aggregate,
fees multiply only the daily rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.windows import change

def by_day() -> WindowSpec:
    return Window.partitionBy("event", "horizon", "fee_rate").orderBy("t")


def positions(panel: DataFrame, triggers: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(event, horizon, date, t, code, active, ret, eligible, bench): a signal holds the next H rows, renewed by another;
    a cell is eligible where its price is known and positive and, if the panel has it, trade_status is positive."""
    price = F.when(F.col("close") > 0, F.col("close"))
    status = F.coalesce(F.col("trade_status") > 0, F.lit(False)) if "trade_status" in panel.columns else F.lit(True)
    cells = panel.select("date", "t", "code", price.alias("price"), status.alias("open")).withColumn("ret", change(F.col("price"))).withColumn("eligible", F.col("price").isNotNull() & F.col("open"))
    was = F.coalesce(F.lag("eligible").over(Window.partitionBy("code").orderBy("t")), F.lit(False))
    cells = cells.withColumn("bench", F.col("eligible") & was).drop("price", "open")
    names = triggers.select("event").distinct()
    x = cells.join(names).join(triggers.select("event", "date", "code", F.lit(True).alias("hit")), ["event", "date", "code"], "left")
    last = F.max(F.when(F.col("hit"), F.col("t"))).over(Window.partitionBy("event", "code").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("age", F.col("t") - last).withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    return x.withColumn("active", F.coalesce(F.col("age") <= F.col("horizon"), F.lit(False)) & F.col("eligible")).drop("age", "hit")


def weights(held: DataFrame) -> DataFrame:
    """Adds weight, the equal share of the day's active cells, and before, the weight of the row before."""
    n = F.count(F.when(F.col("active"), 1)).over(Window.partitionBy("event", "horizon", "t"))
    held = held.withColumn("weight", F.when(F.col("active"), 1.0 / n).otherwise(F.lit(0.0)))
    return held.withColumn("before", F.coalesce(F.lag("weight").over(Window.partitionBy("event", "horizon", "code").orderBy("t")), F.lit(0.0)))


def daily(weighted: DataFrame, fees: Sequence[float]) -> DataFrame:
    """One row per event, horizon, fee and date: returns, cumulative returns, holdings, turnover and cost."""
    d = weighted.groupBy("event", "horizon", "date", "t").agg(
        F.sum(F.col("before") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum(F.abs(F.col("weight") - F.col("before"))).alias("turnover"),
        F.coalesce(F.avg(F.when(F.col("bench"), F.col("ret"))), F.lit(0.0)).alias("benchmark_return"), F.count(F.when(F.col("weight") > 0, 1)).cast("int").alias("holdings"),
        F.count(F.when((F.col("weight") > 0) & (F.col("before") == 0), 1)).alias("entries"), F.count(F.when((F.col("weight") == 0) & (F.col("before") > 0), 1)).alias("exits"),
    )
    d = d.withColumn("fee_rate", F.explode(F.array(*[F.lit(float(f)) for f in fees]))).withColumn("transaction_cost", F.least(F.col("turnover") * F.col("fee_rate"), F.lit(1.0)))
    d = d.withColumn("strategy_return", (1 + F.col("gross")) * (1 - F.col("transaction_cost")) - 1)
    upto = by_day().rowsBetween(Window.unboundedPreceding, 0)
    wealth = lambda c: F.product(1 + F.col(c)).over(upto)
    d = d.withColumn("ws", wealth("strategy_return")).withColumn("wb", wealth("benchmark_return"))
    return d.select("event", "horizon", "fee_rate", "date", "t", "strategy_return", "benchmark_return", (F.col("ws") - 1).alias("strategy_cumulative"), (F.col("wb") - 1).alias("benchmark_cumulative"), (F.col("ws") / F.nullif(F.col("wb"), F.lit(0.0)) - 1).alias("excess_cumulative"), "holdings", "turnover", "transaction_cost", "entries", "exits")


def _annual(total: Column, days: Column, annualization: int) -> Column:
    return F.when(1 + total > 0, F.pow(1 + total, F.lit(float(annualization)) / days) - 1)


def performance(paths: DataFrame, annualization: int = 252, risk_free_rate: float = 0.0) -> DataFrame:
    """Metrics per event, horizon and fee. Drawdown is a positive magnitude from the peak of wealth after each return."""
    if annualization <= 0:
        raise ValueError("annualization must be positive")
    keys = ["event", "horizon", "fee_rate"]
    daily_rf = (1 + risk_free_rate) ** (1 / annualization) - 1
    upto = by_day().rowsBetween(Window.unboundedPreceding, 0)
    wealth = 1 + F.col("strategy_cumulative")
    x = paths.withColumn("drawdown", wealth / F.nullif(F.max(wealth).over(upto), F.lit(0.0)) - 1)
    x = x.withColumn("xr", (1 + F.col("strategy_return")) / F.nullif(1 + F.col("benchmark_return"), F.lit(0.0)) - 1)
    root, r = F.sqrt(F.lit(float(annualization))), F.col("strategy_return")
    held = F.col("holdings") > 0
    m = x.groupBy(*keys).agg(
        F.count("*").alias("days"), F.max_by("strategy_cumulative", "t").alias("total_return"), (F.stddev_samp(r) * root).alias("annualized_volatility"),
        (F.avg(r - daily_rf) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * root).alias("sharpe"), (-F.min("drawdown")).alias("max_drawdown"),
        F.max_by("benchmark_cumulative", "t").alias("benchmark_total_return"), (F.product(1 + F.col("xr")) - 1).alias("excess_total_return"),
        F.avg(held.cast("double")).alias("active_day_ratio"), F.coalesce(F.avg(F.when(held, F.col("holdings"))), F.lit(0.0)).alias("average_holdings"), F.sum("turnover").alias("total_turnover"), F.sum("entries").alias("entries"), F.sum("exits").alias("exits"),
    )
    annual = _annual(F.col("total_return"), F.col("days"), annualization)
    m = m.withColumn("annualized_return", annual).withColumn("benchmark_annualized_return", _annual(F.col("benchmark_total_return"), F.col("days"), annualization)).withColumn("excess_annualized_return", _annual(F.col("excess_total_return"), F.col("days"), annualization))
    return m.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("annualized_return") / F.col("max_drawdown"))).drop("days")


def run_grid(panel: DataFrame, triggers: DataFrame, horizons: Sequence[int], fees: Sequence[float], annualization: int = 252, risk_free_rate: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Daily paths and metrics of every horizon and fee."""
    if any(f < 0 for f in fees):
        raise ValueError("fee rates must not be negative")
    paths = daily(weights(positions(panel, triggers, horizons)), fees)
    return paths, performance(paths, annualization, risk_free_rate)
