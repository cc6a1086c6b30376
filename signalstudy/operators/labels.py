"""Forward labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_code, rows

TYPES = ("ret", "mfe", "mae")


def label_types(types: Sequence[str]) -> list[str]:
    out = list(dict.fromkeys(str(t).lower() for t in types))
    if set(out) - set(TYPES):
        raise ValueError(f"unknown label types: {sorted(set(out) - set(TYPES))}")
    if "ret" not in out:
        raise ValueError("label types must include ret")
    return out


def forward(kind: str, h: int, last_t: Column) -> Column:
    """ret: change to row t+h. mfe, mae: greatest and least close of rows t+1 to t+h against today's, nulls skipped, on
    the rows up to h before the panel's end (the last of them sees a window one row short)."""
    close, base = F.col("close"), F.nullif(F.col("close"), F.lit(0.0))
    if kind == "ret":
        return F.lead(close, h).over(by_code()) / base - 1
    best = (F.max if kind == "mfe" else F.min)(close).over(rows(1, h))
    return F.when(F.col("t") <= last_t + 1 - h, best / base - 1)


def labels_long(panel: DataFrame, horizons: Sequence[int], types: Sequence[str] = ("ret",)) -> DataFrame:
    """(date, t, code, label, horizon, value), one row per panel cell and label; a single exchange and sort."""
    last = F.max("t").over(Window.partitionBy("code"))
    wanted = [(f"{k}_{h}d", int(h), k) for k in label_types(types) for h in horizons]
    wide = panel.select("date", "t", "code", *[forward(k, h, last).alias(n) for n, h, k in wanted])
    cells = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(h).alias("horizon"), F.col(n).alias("value")) for n, h, _ in wanted])
    return wide.select("date", "t", "code", F.explode(cells).alias("l")).select("date", "t", "code", "l.label", "l.horizon", "l.value")
