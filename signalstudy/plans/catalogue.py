"""The query catalogue: every operator on the test tables, with SQL for the same result.

Doubles are rounded to six places on both sides. Windows are scaled down to the monthly panel of the test tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import change, lag, prior_high, rolling_mean, rolling_percentile, rolling_zscore
from ..operators import backtest, controls, factors, inference, paths
from ..operators.events import BreakoutVolumeEvent, EventMeta, FactorExtremeEvent, MaBreakEvent, VolumeStallEvent, as_triggers, detect, meta_frame
from ..operators.labels import labels_long
from ..operators.purge import purge
from ..sources.panel import add_columns, align, lineitem_panel, read_field
from ..sources.store import all_written, written

HORIZONS, GAP, BEFORE, AFTER, FEES, HOLD = (1, 3, 5), 3, 3, 5, (0.0, 0.002), (1, 3)
MODES = controls.MODES

MA = MaBreakEvent(5, 12, 0.25, "ma_break")
STALL = VolumeStallEvent(12, 0.1, 1.2, 0.97, "volume_stall", volume_window=5, high_window=6)
BREAKOUT = BreakoutVolumeEvent(6, 1.2, 5, "breakout", volume_window=5)
HIGH = FactorExtremeEvent("factor", "factor", "high", 0.8, 24, event_name="factor_high")
LOW = FactorExtremeEvent("factor", "factor", "low", 0.8, 24, event_name="factor_low")
EVENTS = (MA, STALL, BREAKOUT)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PANEL = """
raw AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) date, l_suppkey code, CAST(SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/COUNT(*)/100.0e0 AS close,
  MAX(l_extendedprice) high, SUM(l_quantity) volume, ROUND(LN(SUM(l_extendedprice)),6) lncap, CAST(SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS DOUBLE)/COUNT(*) factor FROM lineitem GROUP BY 1,2),
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date)-1 AS BIGINT) t FROM (SELECT DISTINCT date FROM raw) q),
panel AS (SELECT cal.date, cal.t, c.code, raw.close, raw.high, raw.volume, raw.lncap, raw.factor FROM cal CROSS JOIN (SELECT DISTINCT code FROM raw) c LEFT JOIN raw ON raw.date=cal.date AND raw.code=c.code)"""
W = "OVER (PARTITION BY code ORDER BY t)"


def frame(first: str, last: str) -> str:
    return f"OVER (PARTITION BY code ORDER BY t ROWS BETWEEN {first} AND {last})"


def full(agg: str, x: str, n: int, least: int | None = None, last: str = "CURRENT ROW", first: str | None = None) -> str:
    f = frame(first or f"{n - 1} PRECEDING", last)
    return f"CASE WHEN COUNT({x}) {f} >= {least or n} THEN {agg}({x}) {f} END"


def prior(n: int) -> str:
    return full("MAX", "close", n, last="1 PRECEDING", first=f"{n} PRECEDING")


RANKS = "list(factor) FILTER (factor IS NOT NULL) " + frame("23 PRECEDING", "CURRENT ROW")
PCT = f"pct AS (SELECT *, CASE WHEN factor IS NOT NULL AND len(held) >= 20 THEN CAST(len(list_filter(held, lambda z: z <= factor)) AS DOUBLE)/len(held) END AS pct FROM (SELECT *, {RANKS} AS held FROM panel) q)"
RULES = {
    "ma_break": f"lag(close) {W} >= {full('AVG', 'close', 5, last='1 PRECEDING', first='5 PRECEDING')} AND close < {full('AVG', 'close', 5)} AND lag(close,1) {W}/nullif(lag(close,13) {W},0)-1 > 0.25e0",
    "volume_stall": f"close/nullif(lag(close,12) {W},0)-1 > 0.1e0 AND high >= 0.97e0*({prior(6)}) AND volume > 1.2e0*({full('AVG', 'volume', 5)}) AND close <= 1.01e0*lag(close) {W}",
    "breakout": f"close > {prior(6)} AND volume > 1.2e0*({full('AVG', 'volume', 5)}) AND close > {full('AVG', 'close', 5)}",
}
HITS = "flags AS (SELECT date, t, code, " + ", ".join(f"({r}) AS {n}" for n, r in RULES.items()) + " FROM panel),\n" + "hits AS (" + " UNION ALL ".join(f"SELECT '{n}' AS event, date, t, code FROM flags WHERE {n}" for n in RULES) + ")"
KEPT = f"""kept0 AS (SELECT event, code, MIN(t) t FROM hits GROUP BY 1,2 UNION ALL SELECT h.event, h.code, MIN(h.t) t FROM kept0 k JOIN hits h ON h.event=k.event AND h.code=k.code AND h.t > k.t+{GAP} GROUP BY 1,2),
ev AS (SELECT h.* FROM hits h JOIN kept0 k ON h.event=k.event AND h.code=k.code AND h.t=k.t)"""


def label_sql(kinds: tuple[str, ...]) -> str:
    one = {
        "ret": lambda h: f"lead(close,{h}) {W}/nullif(close,0)-1",
        "mfe": lambda h: f"CASE WHEN t <= (SELECT MAX(t) FROM cal)+1-{h} THEN MAX(close) {frame('1 FOLLOWING', f'{h} FOLLOWING')}/nullif(close,0)-1 END",
        "mae": lambda h: f"CASE WHEN t <= (SELECT MAX(t) FROM cal)+1-{h} THEN MIN(close) {frame('1 FOLLOWING', f'{h} FOLLOWING')}/nullif(close,0)-1 END",
    }
    return "labels AS (" + " UNION ALL ".join(f"SELECT date, t, code, '{k}_{h}d' AS label, {h} AS horizon, {one[k](h)} AS value FROM panel" for k in kinds for h in HORIZONS) + ")"


LABELS = label_sql(("ret",))
BUCKETS = """ranked AS (SELECT date, code, lncap, rank() OVER (PARTITION BY date ORDER BY lncap) r, COUNT(*) OVER (PARTITION BY date, lncap) peers, COUNT(*) OVER (PARTITION BY date) n FROM panel WHERE lncap IS NOT NULL),
buckets AS (SELECT p.date, p.code, CASE WHEN r.n IS NOT NULL THEN CAST(least(greatest(ceil((r.r+(r.peers-1)/2.0e0)/r.n*5),1),5) AS INT) END bucket FROM panel p LEFT JOIN ranked r ON r.date=p.date AND r.code=p.code)"""
NON = "non AS (SELECT d.event, l.date, l.code, l.label, l.value FROM labels l JOIN (SELECT DISTINCT event, date FROM ev) d ON d.date=l.date WHERE l.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.event=d.event AND e.date=l.date AND e.code=l.code))"
STAT = "AVG(value) control_mean, MEDIAN(value) control_median, COUNT(value) control_count"
SAME = f"{NON},\nsame AS (SELECT event, label, date, {STAT} FROM non GROUP BY 1,2,3)"
STYLED = f"{BUCKETS},\nstyled AS (SELECT event, label, n.date, bucket, {STAT} FROM non n JOIN buckets b ON b.date=n.date AND b.code=n.code WHERE bucket IS NOT NULL GROUP BY 1,2,3,4)"
ALL = f"uncond AS (SELECT x.event, l.label, {STAT} FROM labels l CROSS JOIN (SELECT DISTINCT event FROM ev) x WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.event=x.event AND e.date=l.date AND e.code=l.code) GROUP BY 1,2)"
HIST = "hist AS (SELECT e.event, l.label, e.date, e.code, AVG(l.value) control_mean, MEDIAN(l.value) control_median, COUNT(l.value) control_count FROM ev e JOIN labels l ON l.code=e.code AND l.date<>e.date AND l.value IS NOT NULL GROUP BY 1,2,3,4)"
OBS_COLUMNS = "o.event, o.date, o.code, o.label, o.horizon, o.event_value, c.control_mean, c.control_median, coalesce(c.control_count,0) AS control_count, o.event_value-c.control_mean AS excess_mean"
OBS = f"""{LABELS},
{SAME},
{STYLED},
{ALL},
{HIST},
own AS (SELECT e.event, e.date, e.code, l.label, l.horizon, l.value AS event_value FROM ev e JOIN labels l ON l.date=e.date AND l.code=e.code WHERE l.value IS NOT NULL),
sty AS (SELECT o.event, o.label, o.date, o.code, CASE WHEN s.control_count>=3 THEN s.control_mean ELSE m.control_mean END control_mean, CASE WHEN s.control_count>=3 THEN s.control_median ELSE m.control_median END control_median, CASE WHEN s.control_count>=3 THEN s.control_count ELSE m.control_count END control_count
  FROM own o LEFT JOIN same m ON m.event=o.event AND m.label=o.label AND m.date=o.date LEFT JOIN buckets b ON b.date=o.date AND b.code=o.code LEFT JOIN styled s ON s.event=o.event AND s.label=o.label AND s.date=o.date AND s.bucket=b.bucket),
obs AS (SELECT {OBS_COLUMNS}, 'same_date' AS mode FROM own o LEFT JOIN same c ON c.event=o.event AND c.label=o.label AND c.date=o.date
  UNION ALL SELECT {OBS_COLUMNS}, 'same_date_style' FROM own o LEFT JOIN sty c ON c.event=o.event AND c.label=o.label AND c.date=o.date AND c.code=o.code
  UNION ALL SELECT {OBS_COLUMNS}, 'unconditional' FROM own o LEFT JOIN uncond c ON c.event=o.event AND c.label=o.label
  UNION ALL SELECT {OBS_COLUMNS}, 'event_stock_history' FROM own o LEFT JOIN hist c ON c.event=o.event AND c.label=o.label AND c.date=o.date AND c.code=o.code)"""
SUMMARY_COLUMNS = """event, label, mode, CAST(COUNT(event_value) AS DOUBLE) events, CAST(COUNT(DISTINCT date) AS DOUBLE) event_dates, AVG(event_value) mean, MEDIAN(event_value) median, AVG(control_mean) control_mean, AVG(excess_mean) excess_mean, MEDIAN(excess_mean) excess_median,
  AVG(CASE WHEN event_value>0 THEN 1e0 ELSE 0e0 END) hit_rate_positive, AVG(CASE WHEN event_value<0 THEN 1e0 ELSE 0e0 END) hit_rate_negative,
  AVG(CASE WHEN excess_mean>0 THEN 1e0 WHEN excess_mean IS NOT NULL THEN 0e0 END) excess_hit_rate_positive, AVG(CASE WHEN excess_mean<0 THEN 1e0 WHEN excess_mean IS NOT NULL THEN 0e0 END) excess_hit_rate_negative"""
SUMMARY_DOUBLES = "events event_dates mean median control_mean excess_mean excess_median hit_rate_positive hit_rate_negative excess_hit_rate_positive excess_hit_rate_negative"
# a p-value that SQL can compute stands in for the bootstrap's in the queries on what follows it
PROXY = f"summ AS (SELECT {SUMMARY_COLUMNS} FROM obs GROUP BY 1,2,3),\nprox AS (SELECT *, CASE WHEN events >= 3 THEN round(1e0/(1e0+events*abs(excess_mean)),6) END AS p FROM summ)"
FDR = """ranked_p AS (SELECT *, row_number() OVER (ORDER BY p) r, COUNT(*) OVER () n FROM prox WHERE p IS NOT NULL),
fdr AS (SELECT * EXCLUDE (r, n), least(1e0, MIN(p*n/r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ranked_p UNION ALL SELECT *, CAST(NULL AS DOUBLE) FROM prox WHERE p IS NULL)"""
PATHS = f"""anch AS (SELECT e.event, e.date, e.t, e.code, p.close AS base FROM ev e JOIN panel p ON p.date=e.date AND p.code=e.code WHERE p.close IS NOT NULL AND p.close<>0 AND e.t>={BEFORE} AND e.t<=(SELECT MAX(t) FROM cal)-{AFTER}),
offs AS (SELECT CAST(range AS INT) AS "offset" FROM range(-{BEFORE},{AFTER + 1})),
ep AS (SELECT a.event, a.date, a.code, o."offset", p.close/a.base-1 AS value FROM anch a CROSS JOIN offs o JOIN panel p ON p.code=a.code AND p.t=a.t+o."offset"),
cc AS (SELECT d.event, d.date, d.t, p.code, p.close AS base FROM (SELECT DISTINCT event, date, t FROM anch) d JOIN panel p ON p.date=d.date WHERE p.close IS NOT NULL AND p.close<>0 AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.event=d.event AND e.date=d.date AND e.code=p.code)),
pc AS (SELECT c.event, c.date, o."offset", AVG(p.close/c.base-1) AS control_mean, COUNT(p.close) AS control_count FROM cc c CROSS JOIN offs o JOIN panel p ON p.code=c.code AND p.t=c.t+o."offset" GROUP BY 1,2,3),
po AS (SELECT ep.*, pc.control_mean, coalesce(pc.control_count,0) AS control_count FROM ep LEFT JOIN pc ON pc.event=ep.event AND pc.date=ep.date AND pc."offset"=ep."offset" WHERE ep.value IS NOT NULL)"""
GROUPS = """ranked_f AS (SELECT date, t, code, factor, (rank() OVER (PARTITION BY code ORDER BY factor)+(COUNT(*) OVER (PARTITION BY code, factor)-1)/2.0e0)/COUNT(*) OVER (PARTITION BY code) AS pct FROM panel WHERE factor IS NOT NULL),
grp AS (SELECT date, t, code, CASE WHEN pct<=0.2e0 THEN 'Q1' WHEN pct<=0.4e0 THEN 'Q2' WHEN pct<=0.6000000000000001e0 THEN 'Q3' WHEN pct<=0.8e0 THEN 'Q4' WHEN pct<=1e0 THEN 'Q5' END AS "group" FROM ranked_f)"""
HOLDS = f"""cells AS (SELECT date, t, code, CASE WHEN close>0 THEN close END AS price, CASE WHEN close>0 THEN close END/nullif(lag(CASE WHEN close>0 THEN close END) {W},0)-1 AS ret, coalesce(close>0,false) AS eligible FROM panel),
cb AS (SELECT *, eligible AND coalesce(lag(eligible) {W}, false) AS bench FROM cells),
sig AS (SELECT x.event, c.*, MAX(CASE WHEN e.t IS NOT NULL THEN c.t END) OVER (PARTITION BY x.event, c.code ORDER BY c.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM cb c CROSS JOIN (SELECT DISTINCT event FROM ev) x LEFT JOIN ev e ON e.event=x.event AND e.date=c.date AND e.code=c.code),
held AS (SELECT event, CAST(h AS INT) AS horizon, date, t, code, ret, eligible, bench, coalesce(t-last<=h, false) AND eligible AS active FROM sig CROSS JOIN (VALUES {', '.join(f'({h})' for h in HOLD)}) hz(h)),
wt0 AS (SELECT *, CASE WHEN active THEN 1e0/COUNT(*) FILTER (WHERE active) OVER (PARTITION BY event, horizon, t) ELSE 0e0 END AS weight FROM held),
wt AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY event, horizon, code ORDER BY t),0e0) AS before FROM wt0)"""
DAILY = f"""{HOLDS},
day0 AS (SELECT event, horizon, date, t, SUM(before*coalesce(ret,0e0)) gross, SUM(abs(weight-before)) turnover, coalesce(AVG(ret) FILTER (WHERE bench),0e0) benchmark_return, CAST(COUNT(*) FILTER (WHERE weight>0) AS INT) holdings, COUNT(*) FILTER (WHERE weight>0 AND before=0) entries, COUNT(*) FILTER (WHERE weight=0 AND before>0) exits FROM wt GROUP BY 1,2,3,4),
day1 AS (SELECT *, least(turnover*fee_rate,1e0) AS transaction_cost FROM day0 CROSS JOIN (VALUES {', '.join(f'({f}e0)' for f in FEES)}) fz(fee_rate)),
day2 AS (SELECT *, (1+gross)*(1-transaction_cost)-1 AS strategy_return FROM day1),
day3 AS (SELECT *, product(1+strategy_return) OVER w AS ws, product(1+benchmark_return) OVER w AS wb FROM day2 WINDOW w AS (PARTITION BY event, horizon, fee_rate ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
daily AS (SELECT event, horizon, fee_rate, date, t, strategy_return, benchmark_return, ws-1 strategy_cumulative, wb-1 benchmark_cumulative, ws/nullif(wb,0)-1 excess_cumulative, holdings, turnover, transaction_cost, entries, exits FROM day3)"""
METRICS = """dd AS (SELECT *, (1+strategy_cumulative)/nullif(MAX(1+strategy_cumulative) OVER (PARTITION BY event, horizon, fee_rate ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0)-1 AS drawdown FROM daily),
m0 AS (SELECT event, horizon, fee_rate, COUNT(*) n_days, arg_max(strategy_cumulative,t) total_return, stddev_samp(strategy_return)*sqrt(12e0) annualized_volatility, AVG(strategy_return)/nullif(stddev_samp(strategy_return),0)*sqrt(12e0) sharpe, -MIN(drawdown) max_drawdown, arg_max(benchmark_cumulative,t) benchmark_total_return,
  product((1+strategy_return)/nullif(1+benchmark_return,0))-1 excess_total_return, AVG(CASE WHEN holdings>0 THEN 1e0 ELSE 0e0 END) active_day_ratio, coalesce(AVG(holdings) FILTER (WHERE holdings>0),0e0) average_holdings, SUM(turnover) total_turnover, CAST(SUM(entries) AS BIGINT) entries, CAST(SUM(exits) AS BIGINT) exits FROM dd GROUP BY 1,2,3),
m AS (SELECT * EXCLUDE (n_days), CASE WHEN 1+total_return>0 THEN pow(1+total_return,12e0/n_days)-1 END annualized_return, CASE WHEN 1+benchmark_total_return>0 THEN pow(1+benchmark_total_return,12e0/n_days)-1 END benchmark_annualized_return, CASE WHEN 1+excess_total_return>0 THEN pow(1+excess_total_return,12e0/n_days)-1 END excess_annualized_return FROM m0),
metrics AS (SELECT *, CASE WHEN max_drawdown>0 THEN annualized_return/max_drawdown END AS calmar FROM m)"""
METRIC_DOUBLES = "total_return annualized_volatility sharpe max_drawdown benchmark_total_return excess_total_return active_day_ratio average_holdings total_turnover annualized_return benchmark_annualized_return excess_annualized_return calmar fee_rate"
DAILY_DOUBLES = "fee_rate strategy_return benchmark_return strategy_cumulative benchmark_cumulative excess_cumulative turnover transaction_cost"
STAT_DOUBLES = "control_mean control_median"
OBS_DOUBLES = f"event_value excess_mean {STAT_DOUBLES}"


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", *ctes: str):
    """Register a query, with its SQL select on the named common table expressions over the panel."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: tidy(build(spark, sf_dir))
        if sql is not None:
            swaps = ", ".join(f"round({c},6)+0.0e0 AS {c}" for c in doubles.split())
            body = f"SELECT * REPLACE ({swaps}) FROM ({sql}) z" if swaps else sql
            ORACLE[name] = f"WITH RECURSIVE {', '.join(x.strip() for x in (PANEL, *ctes))} {body}"
        return build

    return add


def hits(panel: DataFrame) -> DataFrame:
    return detect(panel, EVENTS)


def kept(panel: DataFrame) -> DataFrame:
    return purge(hits(panel), GAP)


def observed(panel: DataFrame, modes=MODES) -> DataFrame:
    """Observations over tables written once: the panel, its labels and triggers."""
    panel = written(panel, "panel")
    labels, triggers = all_written((labels_long(panel, HORIZONS), "labels"), (kept(panel), "triggers"))
    return controls.observations(labels, triggers, modes, controls.style_buckets(panel, "lncap"))


ID = "SELECT date, t, code"


@query("scan_panel", "SELECT date, code, close, high, volume, lncap, factor FROM raw", "close high volume lncap factor")
def _(spark, sf):
    return lineitem_panel(spark, sf).filter("close is not null").select("date", "code", "close", "high", "volume", "lncap", "factor")


@query("panel_align", "SELECT c.date, c.t, k.code, a.close, b.volume FROM c2 c CROSS JOIN k2 k LEFT JOIN raw a ON a.date=c.date AND a.code=k.code LEFT JOIN v b ON b.date=c.date AND b.code=k.code", "close volume",
       "v AS (SELECT date, code, volume FROM raw WHERE code%7<>0 AND date<DATE '1998-06-01')", "k2 AS (SELECT DISTINCT code FROM v)", "c2 AS (SELECT date, CAST(row_number() OVER (ORDER BY date)-1 AS BIGINT) t FROM (SELECT DISTINCT date FROM v) q)")
def _(spark, sf):
    p = lineitem_panel(spark, sf).filter("close is not null")
    # the second field lacks some codes and dates: the panel is what both have
    return align({"close": p.select("date", "code", "close"), "volume": p.filter("code % 7 <> 0 and date < date'1998-06-01'").select("date", "code", "volume")}).select("date", "t", "code", "close", "volume")


@query("factor_join", "SELECT date, t, code, close, factor, lncap FROM panel", "close factor lncap")
def _(spark, sf):
    return lineitem_panel(spark, sf).select("date", "t", "code", "close", "factor", "lncap")


@query("read_field_long", "SELECT date, code, CASE WHEN quantity<50 THEN quantity END AS quantity FROM (SELECT CAST(l_shipdate AS DATE) date, CAST(l_suppkey AS VARCHAR) code, MAX(l_quantity) quantity FROM lineitem WHERE l_shipdate BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' GROUP BY 1,2) q", "quantity")
def _(spark, sf):
    day = F.date_format("l_shipdate", "yyyyMMdd")
    # stored as text, with a value that is no number
    stored = F.when(F.max("l_quantity") < 50, F.max("l_quantity").cast("string")).otherwise("n/a").alias("value")
    source = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(day.alias("date"), F.col("l_suppkey").cast("string").alias("code")).agg(stored)
    return read_field(source, "quantity", start="19930101", end="19971231")


@query("read_field_wide", "SELECT CAST(l_shipdate AS DATE) date, code, MAX(CASE WHEN l_returnflag=code THEN l_quantity END) AS quantity FROM lineitem CROSS JOIN (VALUES ('A'),('N'),('R')) f(code) WHERE l_shipdate>=DATE '1995-01-01' GROUP BY 1,2", "quantity")
def _(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    wide = line.groupBy(F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("date")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_quantity"))
    return read_field(wide, "quantity", start="19950101")


@query("panel_add_columns", "SELECT p.date, p.t, p.code, p.close, CASE WHEN p.volume>=100 THEN p.factor END AS factor, CAST(NULL AS DOUBLE) AS absent FROM panel p", "close factor")
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    extra = {"factor": p.filter("volume >= 100").select("date", "code", "factor"), "absent": None}
    return add_columns(p.select("date", "t", "code", "close"), extra)


@query("win_lag_return", f"{ID}, lag(close) {W} AS before, close/nullif(lag(close) {W},0)-1 AS ret FROM panel", "before ret")
def _(spark, sf):
    return lineitem_panel(spark, sf).select("date", "t", "code", lag(F.col("close"), 1).alias("before"), change(F.col("close")).alias("ret"))


@query("win_rolling_mean", f"{ID}, {full('AVG', 'close', 5)} AS mean5 FROM panel", "mean5")
def _(spark, sf):
    return lineitem_panel(spark, sf).select("date", "t", "code", rolling_mean(F.col("close"), 5).alias("mean5"))


@query("win_prior_high", f"{ID}, {prior(6)} AS high6 FROM panel", "high6")
def _(spark, sf):
    return lineitem_panel(spark, sf).select("date", "t", "code", prior_high(F.col("close"), 6).alias("high6"))


@query("rolling_zscore", f"{ID}, (close-({full('AVG', 'close', 12, 5)}))/nullif({full('stddev_pop', 'close', 12, 5)},0) AS z FROM panel", "z")
def _(spark, sf):
    return lineitem_panel(spark, sf).select("date", "t", "code", rolling_zscore(F.col("close"), 12).alias("z"))


@query("rolling_pct_rank", f"{ID}, pct FROM pct", "pct", PCT)
def _(spark, sf):
    return lineitem_panel(spark, sf).select("date", "t", "code", rolling_percentile(F.col("factor"), 24).alias("pct"))


def _event_query(event, sql, *ctes):
    @query(f"evt_{event.name}", sql, "", *ctes)
    def _(spark, sf):
        return detect(lineitem_panel(spark, sf), [event]).select("date", "t", "code")


for _e in EVENTS:
    _event_query(_e, f"SELECT date, t, code FROM hits WHERE event='{_e.name}'", HITS)
_event_query(HIGH, "SELECT date, t, code FROM pct WHERE pct >= 0.8e0", PCT)
_event_query(LOW, f"SELECT date, t, code FROM pct WHERE pct <= {1.0 - 0.8!r}e0", PCT)


@query("events_long", "SELECT * FROM hits", "", HITS)
def _(spark, sf):
    return hits(lineitem_panel(spark, sf))


@query("external_events", "SELECT 'external' AS event, p.date, p.t, p.code FROM panel p JOIN (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) d, l_suppkey k FROM lineitem WHERE l_quantity>=50) x ON x.d=p.date AND x.k=p.code")
def _(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_quantity >= 50")
    flags = line.select(F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("code"), F.lit(1).alias("flag"))
    return as_triggers(flags, lineitem_panel(spark, sf), "external")


@query("purge_clusters", "SELECT * FROM ev", "", HITS, KEPT)
def _(spark, sf):
    return kept(lineitem_panel(spark, sf))


COOLDOWNS = {"ma_break": 1, "volume_stall": 4, "breakout": 0}
LIMITED = f"""gaps AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {max(2, k)})" for n, k in COOLDOWNS.items())}) g(event, gap)),
lim AS (SELECT event, code, MIN(t) t FROM hits GROUP BY 1,2 UNION ALL SELECT h.event, h.code, MIN(h.t) t FROM lim k JOIN gaps g ON g.event=k.event JOIN hits h ON h.event=k.event AND h.code=k.code AND h.t > k.t+g.gap GROUP BY 1,2)"""


@query("purge_by_event", "SELECT h.* FROM hits h JOIN lim k ON h.event=k.event AND h.code=k.code AND h.t=k.t", "", HITS, LIMITED)
def _(spark, sf):
    # the greater of the study's purge days and the event's own cooldown holds
    meta = meta_frame(spark, [EventMeta(n, cooldown_days=k) for n, k in COOLDOWNS.items()], 2)
    rows = hits(lineitem_panel(spark, sf)).join(F.broadcast(meta.select("event", "cooldown")), "event")
    return purge(rows, F.col("cooldown"))


for _k in ("ret", "mfe", "mae"):
    def _label(spark, sf, k=_k):
        return labels_long(lineitem_panel(spark, sf), HORIZONS, ("ret", k)).filter(F.col("label").startswith(k))

    query(f"label_{_k}", "SELECT * FROM labels", "value", label_sql((_k,)))(_label)


@query("labels_long", "SELECT * FROM labels", "value", label_sql(("ret", "mfe", "mae")))
def _(spark, sf):
    return labels_long(lineitem_panel(spark, sf), HORIZONS, ("ret", "mfe", "mae"))


@query("style_buckets", "SELECT * FROM buckets", "", BUCKETS)
def _(spark, sf):
    return controls.style_buckets(lineitem_panel(spark, sf), "lncap")


@query("ctl_same_date", "SELECT * FROM same", STAT_DOUBLES, HITS, KEPT, LABELS, SAME)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return controls.same_date(*all_written((labels_long(p, HORIZONS), "labels"), (kept(p), "triggers")))


@query("ctl_same_date_style", "SELECT * FROM styled", STAT_DOUBLES, HITS, KEPT, LABELS, SAME, STYLED)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return controls.same_date_style(*all_written((labels_long(p, HORIZONS), "labels"), (kept(p), "triggers")), controls.style_buckets(p, "lncap"))


@query("ctl_unconditional", "SELECT * FROM uncond", STAT_DOUBLES, HITS, KEPT, LABELS, ALL)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return controls.unconditional(*all_written((labels_long(p, HORIZONS), "labels"), (kept(p), "triggers")))


@query("ctl_stock_history", "SELECT e.event, l.label, e.date, e.code, h.control_mean, h.control_median, coalesce(h.control_count,0) AS control_count FROM ev e CROSS JOIN (SELECT DISTINCT label FROM labels) l LEFT JOIN hist h ON h.event=e.event AND h.label=l.label AND h.date=e.date AND h.code=e.code", STAT_DOUBLES, HITS, KEPT, LABELS, HIST)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return controls.stock_history(*all_written((labels_long(p, HORIZONS), "labels"), (kept(p), "triggers")))


RESID = """fit AS (SELECT l.label, l.date, regr_slope(value, lncap) b, regr_avgx(value, lncap) ax, regr_avgy(value, lncap) ay, regr_count(value, lncap) n FROM labels l JOIN panel p ON p.date=l.date AND p.code=l.code GROUP BY 1,2),
resid AS (SELECT l.date, l.t, l.code, l.label, l.horizon, CASE WHEN f.n<4 THEN l.value WHEN p.lncap IS NOT NULL THEN l.value-(f.ay+CASE WHEN f.b IS NULL OR isnan(f.b) THEN 0e0 ELSE f.b END*(p.lncap-f.ax)) END AS value FROM labels l JOIN panel p ON p.date=l.date AND p.code=l.code JOIN fit f ON f.label=l.label AND f.date=l.date)"""


@query("residualize", "SELECT * FROM resid", "value", LABELS, RESID)
def _(spark, sf):
    p = lineitem_panel(spark, sf)
    return controls.residualize(labels_long(p, HORIZONS), p, ["lncap"])


@query("observations", "SELECT * FROM obs", OBS_DOUBLES, HITS, KEPT, OBS)
def _(spark, sf):
    return observed(lineitem_panel(spark, sf))


@query("observations_without_style", "SELECT * REPLACE ('same_date_style' AS mode) FROM obs WHERE mode='same_date'", OBS_DOUBLES, HITS, KEPT, OBS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return controls.observations(*all_written((labels_long(p, HORIZONS), "labels"), (kept(p), "triggers")), ["same_date_style"])


@query("event_paths", "SELECT * FROM ep", "value", HITS, KEPT, PATHS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return paths.event_paths(written(kept(p), "triggers"), p, BEFORE, AFTER)


@query("path_controls", "SELECT * FROM pc", "control_mean", HITS, KEPT, PATHS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return paths.path_controls(written(kept(p), "triggers"), p, BEFORE, AFTER)


@query("path_observations", "SELECT * FROM po", "value control_mean", HITS, KEPT, PATHS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return paths.path_observations(written(kept(p), "triggers"), p, BEFORE, AFTER)


PATH_SUMMARY = 'SELECT event, "offset", AVG(value) mean, MEDIAN(value) median, quantile_cont(value,0.25) p25, quantile_cont(value,0.75) p75, AVG(control_mean) control_mean, AVG(value)-AVG(control_mean) excess_mean FROM po GROUP BY 1,2'


@query("path_summary", PATH_SUMMARY, "mean median p25 p75 control_mean excess_mean", HITS, KEPT, PATHS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return paths.path_summary(paths.path_observations(written(kept(p), "triggers"), p, BEFORE, AFTER))


@query("summary_stats", f"SELECT {SUMMARY_COLUMNS} FROM obs GROUP BY 1,2,3", SUMMARY_DOUBLES, HITS, KEPT, OBS)
def _(spark, sf):
    return inference.summarize(observed(lineitem_panel(spark, sf)))


@query("stability", """SELECT y.event, y.label, y.mode, positive_year_ratio, evaluated_years, recent_signal_edge, prior_signal_edge FROM
 (SELECT event, label, mode, AVG(CASE WHEN e>0 THEN 1e0 ELSE 0e0 END) positive_year_ratio, CAST(COUNT(*) AS DOUBLE) evaluated_years FROM (SELECT event, label, mode, year(date) y, AVG(edge) e FROM x GROUP BY 1,2,3,4) q GROUP BY 1,2,3) y
 JOIN (SELECT x.event, x.label, x.mode, AVG(edge) FILTER (WHERE x.date>=split) recent_signal_edge, AVG(edge) FILTER (WHERE x.date<split) prior_signal_edge FROM x JOIN sp ON sp.event=x.event AND sp.label=x.label AND sp.mode=x.mode GROUP BY 1,2,3) h ON h.event=y.event AND h.label=y.label AND h.mode=y.mode""",
       "positive_year_ratio evaluated_years recent_signal_edge prior_signal_edge", HITS, KEPT, OBS,
       "x AS (SELECT *, CASE WHEN event='breakout' THEN excess_mean ELSE -excess_mean END AS edge FROM obs WHERE excess_mean IS NOT NULL)",
       "ds AS (SELECT event, label, mode, list_sort(list(DISTINCT date)) dl FROM x GROUP BY 1,2,3)", "sp AS (SELECT event, label, mode, dl[least(greatest(1, CAST(floor(len(dl)*2/3) AS INT)), len(dl)-1)+1] AS split FROM ds)")
def _(spark, sf):
    return inference.stability(observed(lineitem_panel(spark, sf)), meta_frame(spark, [e.meta for e in EVENTS]))


@query("bootstrap_clusters", "SELECT event, label, mode, date, SUM(excess_mean) total, COUNT(*) n FROM obs WHERE excess_mean IS NOT NULL GROUP BY 1,2,3,4", "total", HITS, KEPT, OBS)
def _(spark, sf):
    return inference.clusters(observed(lineitem_panel(spark, sf)))


@query("bootstrap_effect")
def bootstrapped(spark, sf):
    return inference.bootstrap(observed(lineitem_panel(spark, sf)))


@query("bootstrap_bounds", "SELECT event, label, mode, CAST(COUNT(DISTINCT date) AS DOUBLE) bootstrap_clusters, true AS ordered, true AS share FROM obs WHERE excess_mean IS NOT NULL GROUP BY 1,2,3 HAVING COUNT(DISTINCT date)>1", "bootstrap_clusters", HITS, KEPT, OBS)
def _(spark, sf):
    # what SQL can say of a random result: its keys, its clusters and the order of its figures
    obs = observed(lineitem_panel(spark, sf))
    mean = obs.groupBy("event", "label", "mode").agg(F.avg("excess_mean").alias("mean"))
    x = inference.bootstrap(obs).filter("ci_low is not null").join(mean, ["event", "label", "mode"])
    return x.select("event", "label", "mode", F.col("bootstrap_clusters").cast("double").alias("bootstrap_clusters"), F.col("mean").between(F.col("ci_low"), F.col("ci_high")).alias("ordered"), ((F.col("bootstrap_p") > 0) & (F.col("bootstrap_p") <= 1)).alias("share"))


@query("bootstrap_two_sample")
def two_samples(spark, sf):
    obs = observed(lineitem_panel(spark, sf), ["same_date"]).filter("excess_mean is not null")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["date", "code"])
        return pd.DataFrame([{"event": pdf.event.iloc[0], "label": pdf.label.iloc[0], **inference.bootstrap_two_sample(pdf.event_value, pdf.control_mean)}])

    return obs.select("event", "label", "date", "code", "event_value", "control_mean").groupBy("event", "label").applyInPandas(run, "event string, label string, observed double, p_value double, ci_low double, ci_high double")


@query("two_sample_bounds", "SELECT event, label, AVG(event_value)-AVG(control_mean) AS observed, true AS ordered, true AS share FROM obs WHERE mode='same_date' AND excess_mean IS NOT NULL GROUP BY 1,2", "observed", HITS, KEPT, OBS)
def _(spark, sf):
    x = two_samples(spark, sf)
    return x.select("event", "label", "observed", F.col("observed").between(F.col("ci_low"), F.col("ci_high")).alias("ordered"), ((F.col("p_value") > 0) & (F.col("p_value") <= 1)).alias("share"))


def proxied(spark, sf) -> DataFrame:
    s = inference.summarize(observed(lineitem_panel(spark, sf)))
    p = F.when(F.col("events") >= 3, F.round(1.0 / (1.0 + F.col("events") * F.abs("excess_mean")), 6))
    return inference.bh_fdr(s.withColumn("p", p), "p", "q")


@query("bh_fdr", "SELECT event, label, mode, p, q FROM fdr", "p q", HITS, KEPT, OBS, PROXY, FDR)
def _(spark, sf):
    return proxied(spark, sf).select("event", "label", "mode", "p", "q")


def assessed(spark, sf) -> DataFrame:
    x = proxied(spark, sf).withColumnRenamed("q", "q_value").join(F.broadcast(meta_frame(spark, [e.meta for e in EVENTS]).select("event", "direction")), "event")
    half = F.col("p") / 10
    x = x.withColumn("ci_low", F.col("excess_mean") - half).withColumn("ci_high", F.col("excess_mean") + half).withColumn("bootstrap_clusters", F.col("event_dates")).withColumn("horizon", F.regexp_extract("label", r"_(\d+)d", 1).cast("int"))
    return inference.assess(inference.directed(x), 0.5)


ASSESS = """dirs AS (SELECT *, CASE WHEN event='breakout' THEN 'entry' ELSE 'exit' END AS direction, excess_mean-p/10 AS ci_low, excess_mean+p/10 AS ci_high, CAST(regexp_extract(label,'_(\\d+)d',1) AS INT) AS horizon FROM fdr),
dir2 AS (SELECT *, CASE WHEN direction='exit' THEN -excess_mean ELSE excess_mean END signal_edge, CASE WHEN direction='exit' THEN excess_hit_rate_negative ELSE excess_hit_rate_positive END directional_hit_rate, CASE WHEN direction='exit' THEN -ci_high ELSE ci_low END signal_ci_low, CASE WHEN direction='exit' THEN -ci_low ELSE ci_high END signal_ci_high FROM dirs),
assessed AS (SELECT *, CASE WHEN events<5 OR event_dates<5 THEN 'too_few' WHEN coalesce(q<0.5e0,false) AND coalesce(signal_ci_low>0,false) THEN direction WHEN coalesce(q<0.5e0,false) AND coalesce(signal_ci_high<0,false) THEN 'opposite' ELSE 'none' END AS verdict, coalesce(q<0.5e0,false) AND coalesce(signal_ci_low>0,false) AS significant_fdr FROM dir2)"""


@query("assessment", "SELECT event, label, mode, direction, signal_edge, directional_hit_rate, signal_ci_low, signal_ci_high, verdict, significant_fdr FROM assessed", "signal_edge directional_hit_rate signal_ci_low signal_ci_high", HITS, KEPT, OBS, PROXY, FDR, ASSESS)
def _(spark, sf):
    return assessed(spark, sf).select("event", "label", "mode", "direction", "signal_edge", "directional_hit_rate", "signal_ci_low", "signal_ci_high", "verdict", "significant_fdr")


@query("decision_summary", "SELECT event, mode, label, horizon, q, signal_edge, verdict FROM (SELECT *, row_number() OVER (PARTITION BY event, mode ORDER BY coalesce(q,2e0), signal_edge DESC NULLS LAST, horizon) k FROM assessed) s WHERE k=1", "q signal_edge", HITS, KEPT, OBS, PROXY, FDR, ASSESS)
def _(spark, sf):
    return inference.decision_summary(assessed(spark, sf)).select("event", "mode", "label", "horizon", F.col("q_value").alias("q"), "signal_edge", "verdict")


@query("quantile_groups", "SELECT * FROM grp", "", GROUPS)
def _(spark, sf):
    return factors.quantile_groups(lineitem_panel(spark, sf), "factor")


FACTOR = """fx AS (SELECT l.label, l.horizon, g."group", l.value AS v FROM grp g JOIN labels l ON l.date=g.date AND l.code=g.code WHERE l.value IS NOT NULL),
fq AS (SELECT *, quantile_cont(v,0.05) OVER (PARTITION BY label, "group") q FROM fx),
fg AS (SELECT label, horizon, "group", COUNT(v) "count", AVG(v) mean, MEDIAN(v) median, stddev_samp(v) std, AVG(v)/nullif(stddev_samp(v),0)*sqrt(252e0) sharpe, AVG(CASE WHEN v>0 THEN 1e0 ELSE 0e0 END) hit_rate_positive, AVG(CASE WHEN v<0 THEN 1e0 ELSE 0e0 END) hit_rate_negative, AVG(v) FILTER (WHERE v<=q) cvar_5 FROM fq GROUP BY 1,2,3),
fgs AS (SELECT fg.*, c.control_mean, fg.mean-c.control_mean AS excess_mean FROM fg JOIN (SELECT label, AVG(value) control_mean FROM labels WHERE value IS NOT NULL GROUP BY 1) c ON c.label=fg.label)"""


@query("factor_groups", "SELECT * FROM fgs", "mean median std sharpe hit_rate_positive hit_rate_negative cvar_5 control_mean excess_mean", GROUPS, LABELS, FACTOR)
def _(spark, sf):
    p = lineitem_panel(spark, sf)
    return factors.group_label_summary(factors.quantile_groups(p, "factor"), labels_long(p, HORIZONS))


@query("cvar", "SELECT label, AVG(value) FILTER (WHERE value<=q) cvar FROM (SELECT label, value, quantile_cont(value,0.05) OVER (PARTITION BY label) q FROM labels WHERE value IS NOT NULL) s GROUP BY 1", "cvar", LABELS)
def _(spark, sf):
    return factors.cvar(labels_long(lineitem_panel(spark, sf), HORIZONS), ["label"])


@query("bt_active_positions", "SELECT event, horizon, date, t, code FROM held WHERE active", "", HITS, KEPT, HOLDS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return backtest.positions(p, written(kept(p), "triggers"), HOLD).filter("active").select("event", "horizon", "date", "t", "code")


@query("bt_weights", "SELECT event, horizon, date, t, code, weight, before FROM wt WHERE weight>0 OR before>0", "weight before", HITS, KEPT, HOLDS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return backtest.weights(backtest.positions(p, written(kept(p), "triggers"), HOLD)).filter("weight > 0 or before > 0").select("event", "horizon", "date", "t", "code", "weight", "before")


@query("bt_daily", "SELECT * FROM daily", DAILY_DOUBLES, HITS, KEPT, DAILY)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return backtest.run_grid(p, written(kept(p), "triggers"), HOLD, FEES, 12)[0]


@query("bt_metrics", "SELECT * FROM metrics", METRIC_DOUBLES, HITS, KEPT, DAILY, METRICS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return backtest.run_grid(p, written(kept(p), "triggers"), HOLD, FEES, 12)[1]


@query("bt_grid", "SELECT event, horizon, fee_rate, total_return, sharpe, max_drawdown, excess_total_return FROM metrics", "fee_rate total_return sharpe max_drawdown excess_total_return", HITS, KEPT, DAILY, METRICS)
def _(spark, sf):
    p = written(lineitem_panel(spark, sf), "panel")
    return backtest.run_grid(p, written(kept(p), "triggers"), HOLD, FEES, 12)[1].select("event", "horizon", "fee_rate", "total_return", "sharpe", "max_drawdown", "excess_total_return")


@query("recent_events", f"SELECT s.event, strftime(s.date,'%Y-%m-%d') AS date, s.code, p.close, {', '.join(f'MAX(CASE WHEN horizon={h} THEN value END) AS ret_{h}d' for h in HORIZONS)} FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY date DESC, code DESC) k FROM ev) s JOIN panel p ON p.date=s.date AND p.code=s.code JOIN labels l ON l.date=s.date AND l.code=s.code WHERE k<=30 GROUP BY 1,2,3,4", "close " + " ".join(f"ret_{h}d" for h in HORIZONS), HITS, KEPT, LABELS)
def _(spark, sf):
    from .study import recent_events

    p = written(lineitem_panel(spark, sf), "panel")
    return recent_events(written(kept(p), "triggers"), p, labels_long(p, HORIZONS), HORIZONS)


@query("histogram", "SELECT o.event, o.label, CAST(least(49, floor((event_value-lo)/nullif(hi-lo,0)*50)) AS INT) bin, COUNT(*) n FROM obs o JOIN (SELECT event, label, MIN(event_value) lo, MAX(event_value) hi FROM obs WHERE mode='same_date' GROUP BY 1,2) r ON r.event=o.event AND r.label=o.label WHERE mode='same_date' GROUP BY 1,2,3", "", HITS, KEPT, OBS)
def _(spark, sf):
    from .report import histogram

    return histogram(observed(lineitem_panel(spark, sf), ["same_date"]))


@query("date_window_stats", "SELECT event, label, mode, COUNT(event_value) n, AVG(event_value) mean, AVG(excess_mean) excess_mean, CASE WHEN event='breakout' THEN AVG(excess_mean) ELSE -AVG(excess_mean) END edge, AVG(CASE WHEN (event='breakout' AND excess_mean>0) OR (event<>'breakout' AND excess_mean<0) THEN 1e0 WHEN excess_mean IS NOT NULL THEN 0e0 END) directional_hit FROM obs WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY 1,2,3", "mean excess_mean edge directional_hit", HITS, KEPT, OBS)
def _(spark, sf):
    from .report import date_window_stats

    return date_window_stats(observed(lineitem_panel(spark, sf)), meta_frame(spark, [e.meta for e in EVENTS]), "1994-01-01", "1996-12-31")


SAMPLE = """keys AS (SELECT event, date, code, COUNT(*) n FROM obs GROUP BY 1,2,3),
few AS (SELECT event, date, code FROM keys ORDER BY md5(concat_ws('|', event, strftime(date,'%Y-%m-%d'), CAST(code AS VARCHAR), '42')), event, date, code LIMIT (SELECT CASE WHEN SUM(n)<=500 THEN COUNT(*) ELSE greatest(1, CAST(floor(500/(SUM(n)*1e0/COUNT(*))) AS BIGINT)) END FROM keys))"""


@query("report_sample", "SELECT o.* FROM obs o JOIN few f ON f.event=o.event AND f.date=o.date AND f.code=o.code", OBS_DOUBLES, HITS, KEPT, OBS, SAMPLE)
def _(spark, sf):
    from .report import sample_events

    return sample_events(observed(lineitem_panel(spark, sf)), 500)


FLAGSHIP = "SELECT event, label, CAST(COUNT(*) AS BIGINT) events, AVG(event_value) mean, AVG(control_mean) control_mean, AVG(excess_mean) excess_mean FROM obs WHERE mode='same_date' AND event='ma_break' GROUP BY 1,2"


@query("flagship_summary", FLAGSHIP, "mean control_mean excess_mean", HITS, KEPT, OBS)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """After a moving-average break, what is the mean excess return against stocks without one on that date?"""
    p = lineitem_panel(spark, sf)
    obs = controls.observations(labels_long(p, HORIZONS), purge(detect(p, [MA]), GAP), ["same_date"])
    return obs.groupBy("event", "label").agg(F.count("*").alias("events"), F.avg("event_value").alias("mean"), F.avg("control_mean").alias("control_mean"), F.avg("excess_mean").alias("excess_mean"))
