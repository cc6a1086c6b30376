"""Panels: dense long tables (date, t, code, fields...). t counts the panel's dates from 0; every window counts rows of t."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stored names of price fields and what panels call them.
STORED_FIELDS = {"adj_open": "open", "adj_high": "high", "adj_low": "low", "adj_close": "close", "adj_vwap": "vwap"}
DEFAULT_FIELDS = ("adj_open", "adj_high", "adj_low", "adj_close", "volume", "amount")
EVENT_FIELDS = ("open", "high", "low", "close", "volume", "amount", "trade_status")


def normalize_code(code: Column) -> Column:
    """NNNNNN.{SZ,SH,BJ}: suffixed codes stay, else six digits get the suffix of their first; others raise."""
    c = F.upper(F.trim(code))
    digits = F.regexp_replace(c, "[^0-9]", "")
    first = F.substring(digits, 1, 1)
    suffix = F.when(first.isin("0", "2", "3"), ".SZ").when(first == "6", ".SH").when(first.isin("4", "8", "9"), ".BJ")
    made = F.when(F.length(digits) == 6, F.concat(digits, suffix))
    return F.when(c.isNull() | c.rlike(r"\.(SZ|SH|BJ)$"), c).otherwise(F.coalesce(made, F.raise_error(F.concat(F.lit("not a stock code: "), c)).cast("string")))


def parse_date(text: Column) -> Column:
    """A date from yyyyMMdd, null where it is none."""
    return F.try_to_timestamp(text.cast("string"), F.lit("yyyyMMdd")).cast("date")


def read_field(source: DataFrame, name: str, codes: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A stored wide (date, one column per code) or long (date, code, value) table as (date, code, name).

    Codes and date range reach the scan; values that are no numbers and NaN become null.
    """
    if dict(source.dtypes)["date"] in ("string", "int", "bigint"):  # stored as yyyyMMdd: the range reaches the scan as it is
        like = F.lit if dict(source.dtypes)["date"] == "string" else lambda day: F.lit(int(day))
        source = source.filter(F.col("date") >= like(start)) if start else source
        source = source.filter(F.col("date") <= like(end)) if end else source
    date = F.col("date") if dict(source.dtypes)["date"] in ("date",) else F.col("date").cast("date") if dict(source.dtypes)["date"].startswith("timestamp") else parse_date(F.col("date"))
    if "code" in source.columns:
        value = next(c for c in source.columns if c not in ("date", "code"))
        df = source.select(date.alias("date"), "code", F.col(value).alias(name))
        df = df.filter(F.col("code").isin(list(codes))) if codes else df
    else:
        wanted = [c for c in source.columns if c != "date" and (not codes or c in set(codes))]
        df = source.select(date.alias("date"), *[F.col(f"`{c}`").cast("string").alias(c) for c in wanted]).unpivot("date", wanted, "code", name)
    number = F.expr(f"try_cast(`{name}` AS double)")
    df = df.withColumn(name, F.nanvl(number, F.lit(None).cast("double"))).filter("date is not null")
    df = df.filter(F.col("date") >= F.to_date(F.lit(start), "yyyyMMdd")) if start else df
    return df.filter(F.col("date") <= F.to_date(F.lit(end), "yyyyMMdd")) if end else df


def align(fields: Mapping[str, DataFrame]) -> DataFrame:
    """One dense panel on the dates and codes that all fields have: labels are intersected, empty cells stay null."""
    dates = reduce(DataFrame.intersect, [f.select("date") for f in fields.values()])
    codes = reduce(DataFrame.intersect, [f.select("code") for f in fields.values()])
    calendar = dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("t"))
    # the grid is the panel itself: its size is what is asked for
    grid = calendar.join(codes)
    return reduce(lambda g, item: g.join(item[1].select("date", "code", item[0]), ["date", "code"], "left"), fields.items(), grid)


def add_columns(panel: DataFrame, extra: Mapping[str, DataFrame | None]) -> DataFrame:
    """Factors and styles as further columns of the panel; a missing table gives nulls."""
    for name, df in extra.items():
        panel = panel.withColumn(name, F.lit(None).cast("double")) if df is None else panel.join(df.select("date", "code", F.col(name)), ["date", "code"], "left")
    return panel


def load_field(spark: SparkSession, root: str, collection: str, name: str | None = None, **where) -> DataFrame:
    logical = name or STORED_FIELDS.get(collection, collection)
    return read_field(spark.read.parquet(f"{root}/{collection}"), logical, **where)


def load_market_panel(spark: SparkSession, root: str, fields: Iterable[str] = DEFAULT_FIELDS, **where) -> DataFrame:
    return align({STORED_FIELDS.get(f, f): load_field(spark, root, f, **where) for f in fields})


def load_style_controls(spark: SparkSession, root: str, collection: str = "Lncap", **where) -> DataFrame | None:
    """The size style, or None if the store has none."""
    from pyspark.errors import AnalysisException

    try:
        return load_field(spark, root, collection, "lncap", **where)
    except AnalysisException:
        return None


def required_collections(events, style: str | None = None) -> list[str]:
    """Stored fields that the events read, close always among them; unknown fields raise."""
    needed = {"close"}.union(*[e.required_fields for e in events]) if events else {"close"}
    unknown = sorted(needed - set(EVENT_FIELDS))
    if unknown:
        raise ValueError(f"unknown event fields: {unknown}")
    stored = {v: k for k, v in STORED_FIELDS.items()}
    return [stored.get(f, f) for f in EVENT_FIELDS if f in needed]


def required_factors(events) -> dict[str, str]:
    """Factor name to source over all events; each is read once, and two sources for one name raise."""
    out: dict[str, str] = {}
    for e in events:
        for name, source in e.factor_sources().items():
            if out.setdefault(name, source) != source:
                raise ValueError(f"factor {name} is declared as both {out[name]} and {source}")
    return out


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel of the test tables: suppliers as codes; close, high, volume, lncap and factor as fields."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
    raw = line.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("code")).agg(
        (cents("l_extendedprice") / F.count("*") / 100.0).alias("close"),
        F.max("l_extendedprice").alias("high"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.log(F.sum("l_extendedprice")), 6).alias("lncap"),
        (cents("l_discount") / F.count("*")).alias("factor"),
    )
    dates = raw.select("date").distinct()
    calendar = dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("t"))
    return calendar.join(raw.select("code").distinct()).join(raw, ["date", "code"], "left")
