"""python -m signalstudy.plans.cli: a study from a folder of stored fields to tables and a report."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources import panel as source
from . import cache, config, report
from .study import EventStudyRunner


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    """Command line over the configuration's run section."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=str(Path(__file__).with_name("default.yaml")))
    known, _ = first.parse_known_args(argv)
    run = config.load_run(known.config)
    p = argparse.ArgumentParser(parents=[first])
    p.add_argument("--data", required=True, help="folder with one Parquet table per field")
    p.add_argument("--codes", nargs="*", default=run.get("codes"))
    for name in ("start", "end", "output_dir", "cache_dir", "style_name"):
        p.add_argument(f"--{name.replace('_', '-')}", default=run.get(name))
    for name in ("horizons", "label_types", "control_modes", "backtest_fees"):
        p.add_argument(f"--{name.replace('_', '-')}", nargs="*", type=int if name == "horizons" else float if name == "backtest_fees" else str, default=run.get(name))
    for name in ("bootstrap", "n_jobs", "min_events", "style_bins", "purge_days", "report_max_rows", "annualization", "window_before", "window_after"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=run.get(name))
    for name in ("significance_level", "risk_free_rate"):
        p.add_argument(f"--{name.replace('_', '-')}", type=float, default=run.get(name))
    for name in ("residualize_styles", "show_progress", "use_gpu", "use_cache", "refresh_cache"):
        p.add_argument(f"--{name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=run.get(name, False))
    args = p.parse_args(argv)
    if args.n_jobs is not None and args.n_jobs < 1:
        p.error("--n-jobs must be 1 or more")
    return args


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    events = config.load_events(args.config)
    study = config.study_config({k: v for k, v in vars(args).items() if v is not None})
    # n_jobs has no effect: Spark runs the tasks of all events side by side
    spark = SparkSession.builder.appName("signalstudy").config("spark.ui.showConsoleProgress", str(bool(args.show_progress)).lower()).getOrCreate()
    where = {"codes": args.codes, "start": args.start, "end": args.end}
    panel = source.load_market_panel(spark, args.data, source.required_collections(events), **where)
    panel = source.add_columns(panel, {n: source.load_field(spark, args.data, s, n, **where) for n, s in source.required_factors(events).items()})
    panel = source.add_columns(panel, {"lncap": source.load_style_controls(spark, args.data, **where)}).persist()
    factors = list(source.required_factors(events))
    out = args.output_dir or "outputs"
    if args.use_cache and args.cache_dir:
        result, hits = cache.run_cached(panel, events, study, cache.EventResultCache(args.cache_dir), args.refresh_cache, where, factors)
        print("cache:", hits)
    else:
        result = EventStudyRunner(panel, events, study, factors).run()
    report.write_tables(result, out)
    report.render(result, f"{out}/report.html", args.report_max_rows or 100_000)
    result.summary.select("event", "label", "mode", "events", "excess_mean", "signal_edge", "bootstrap_p", "q_value", "verdict", "significant_fdr").limit(20).show(truncate=False)


if __name__ == "__main__":
    main()
