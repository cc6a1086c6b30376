"""A whole study as one lazy plan: panel -> triggers -> purge -> labels x controls -> inference, paths, recents, groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import backtest, controls, factors, inference, paths
from ..operators.events import Event, EventMeta, as_triggers, detect, meta_frame
from ..operators.labels import label_types, labels_long
from ..operators.purge import purge
from ..sources.store import all_written, written


@dataclass(frozen=True)
class EventStudyConfig:
    horizons: Sequence[int] = (1, 3, 5, 10, 20)
    label_types: Sequence[str] = ("ret",)
    window_before: int = 10
    window_after: int = 20
    n_bootstrap: int = 2000
    min_events: int = 5
    significance_level: float = 0.05
    control_modes: Sequence[str] = ("same_date", "same_date_style")
    style_name: str = "lncap"
    style_bins: int = 5
    min_controls: int = 3
    purge_days: int = 10
    residualize_styles: bool = False
    seed: int = 42
    use_gpu: bool = False
    backtest_fees: Sequence[float] = (0.0, 0.002)
    annualization: int = 252
    risk_free_rate: float = 0.0

    def __post_init__(self) -> None:
        if not self.horizons or any(int(h) <= 0 for h in self.horizons):
            raise ValueError("horizons must be positive integers")
        label_types(self.label_types)
        if set(self.control_modes) - set(controls.MODES) or not self.control_modes:
            raise ValueError("unknown or no control modes")
        if self.window_before < 0 or self.window_after < 0 or self.n_bootstrap < 0 or self.min_events < 1 or self.style_bins < 1:
            raise ValueError("windows, repetitions and bounds must not be negative")
        if not 0 < self.significance_level < 1:
            raise ValueError("significance_level must lie between 0 and 1")
        if any(f < 0 for f in self.backtest_fees) or self.annualization <= 0:
            raise ValueError("fees must not be negative and annualization must be positive")


@dataclass
class EventStudyResult:
    """Lazy tables, each with an event column."""

    triggers: DataFrame
    summary: DataFrame
    observations: DataFrame
    path_observations: DataFrame
    path_summary: DataFrame
    recent: DataFrame
    groups: DataFrame | None = None
    backtests: DataFrame | None = None
    metrics: DataFrame | None = None


def recent_events(triggers: DataFrame, panel: DataFrame, labels: DataFrame, horizons: Sequence[int], limit: int = 30) -> DataFrame:
    """The last triggers of each event by date and code, with close and return labels as columns, latest first."""
    w = Window.partitionBy("event").orderBy(F.desc("date"), F.desc("code"))
    last = triggers.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).select("event", "date", "code")
    wide = last.join(labels.filter(F.col("label").startswith("ret_")).select("date", "code", "label", "value"), ["date", "code"]).groupBy("event", "date", "code").agg(*[F.max(F.when(F.col("label") == f"ret_{h}d", F.col("value"))).alias(f"ret_{h}d") for h in horizons])
    out = wide.join(panel.select("date", "code", "close"), ["date", "code"])
    return out.orderBy(F.desc("date"), "event").select("event", F.date_format("date", "yyyy-MM-dd").alias("date"), "code", "close", *[f"ret_{h}d" for h in horizons])


def group_summaries(panel: DataFrame, names: Sequence[str], labels: DataFrame) -> DataFrame | None:
    """Per factor, label and quantile group the summary of the return labels, or None without factors."""
    out = None
    for name in names:
        g = factors.group_label_summary(factors.quantile_groups(panel, name), labels.filter(F.col("label").startswith("ret_"))).withColumn("factor", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


@dataclass
class EventStudyRunner:
    """panel: date, t, code, fields, styles and factors. event_matrices: name -> (date, code[, flag]) of external triggers,
    which replace generated ones of the same name; event_meta overrides what events say of themselves."""

    panel: DataFrame
    events: Sequence[Event] = ()
    config: EventStudyConfig = field(default_factory=EventStudyConfig)
    factors: Sequence[str] = ()
    event_matrices: Mapping[str, DataFrame] = field(default_factory=dict)
    event_meta: Mapping[str, EventMeta] = field(default_factory=dict)

    def metas(self) -> dict[str, EventMeta]:
        return {**{n: EventMeta(n) for n in self.event_matrices}, **{e.name: e.meta for e in self.events}, **self.event_meta}

    def triggers(self, panel: DataFrame | None = None) -> DataFrame:
        """Purged triggers of all events; panel may be a written copy of the runner's own."""
        panel = self.panel if panel is None else panel
        parts = [as_triggers(df, panel, n) for n, df in self.event_matrices.items()]
        made = [e for e in self.events if e.name not in self.event_matrices]
        parts += [detect(panel, made)] if made else []
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        meta = meta_frame(self.panel.sparkSession, list(self.metas().values()), self.config.purge_days)
        return purge(out.join(F.broadcast(meta.select("event", "cooldown")), "event"), F.col("cooldown"))

    def run(self, with_backtests: bool = True) -> EventStudyResult:
        c, panel = self.config, self.panel
        spark = panel.sparkSession
        metas = self.metas()
        if c.use_gpu:
            print("use_gpu has no effect: the bootstrap runs on executors")
        meta = meta_frame(spark, list(metas.values()), c.purge_days)
        # what several results read is written once
        panel = written(panel, "study-panel")
        triggers, raw = all_written((self.triggers(panel), "study-triggers"), (labels_long(panel, c.horizons, c.label_types), "study-labels"))
        styled = c.style_name in panel.columns
        labels = written(controls.residualize(raw, panel, [c.style_name]), "study-labels") if c.residualize_styles and styled else raw
        buckets = controls.style_buckets(panel, c.style_name, c.style_bins) if styled else None
        obs = written(controls.observations(labels, triggers, c.control_modes, buckets, c.min_controls), "study-observations")
        names = [f"{k}_{h}d" for k in label_types(c.label_types) for h in c.horizons]
        horizon = {f"{k}_{h}d": int(h) for k in label_types(c.label_types) for h in c.horizons}
        grid = spark.createDataFrame([(e, n, m) for e in metas for n in names for m in c.control_modes], "event string, label string, mode string")
        info = meta.select("event", "direction", "description")
        s = inference.summarize(obs, grid).join(inference.bootstrap(obs, c.n_bootstrap, c.seed), inference.KEYS, "left").join(inference.stability(obs, meta), inference.KEYS, "left")
        s = s.join(F.broadcast(info), "event").withColumn("horizon", F.create_map(*[F.lit(x) for kv in horizon.items() for x in kv])[F.col("label")])
        s = s.na.fill(0.0, ["bootstrap_clusters", "evaluated_years"]).withColumn("residualized", F.lit(c.residualize_styles)).withColumn("bootstrap_method", F.lit(inference.BOOTSTRAP_METHOD))
        summary = inference.assess(inference.bh_fdr(inference.directed(s)), c.significance_level, c.min_events)
        observed = paths.path_observations(triggers, panel, c.window_before, c.window_after)
        groups = group_summaries(panel, self.factors, raw)
        result = EventStudyResult(triggers, summary, obs.join(F.broadcast(info), "event"), observed, paths.path_summary(observed), recent_events(triggers, panel, raw, c.horizons), groups)
        if with_backtests:
            result.backtests, result.metrics = backtest.run_grid(panel, triggers, c.horizons, c.backtest_fees, c.annualization, c.risk_free_rate)
        return result
