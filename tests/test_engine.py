"""Fixtures F1 to F13 of FIXTURES.md, and the catalogue against SQL."""

import datetime as dt
import json
import shutil
import subprocess

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalstudy.operators import backtest, controls, factors, inference, paths
from signalstudy.operators.events import Event, EventDefinition, EventMeta, FactorExtremeEvent, MaBreakEvent, as_triggers, detect
from signalstudy.operators.labels import labels_long
from signalstudy.operators.purge import purge
from signalstudy.plans import config
from signalstudy.plans.study import EventStudyConfig, EventStudyRunner
from signalstudy.sources.panel import align, normalize_code, read_field, required_collections, required_factors


def panel_of(spark, columns, start="2024-01-01", **more):
    days = pd.date_range(start, periods=len(next(iter(columns.values()))))
    rows = [(d.date(), t, c, *[float(x) if x is not None else None for x in (v[t], *[m[c][t] for m in more.values()])]) for c, v in columns.items() for t, d in enumerate(days)]
    return spark.createDataFrame(rows, "date date, t long, code string, close double" + "".join(f", {m} double" for m in more))


def triggers_of(spark, panel, cells, name="e"):
    x = spark.createDataFrame(cells, "t long, code string")
    return panel.join(x, ["t", "code"]).select(F.lit(name).alias("event"), "date", "t", "code")


def test_codes(spark):
    df = spark.createDataFrame([("300308",), ("sh600000",), ("300274.SZ",)], "c string")
    assert [r[0] for r in df.select(normalize_code(F.col("c"))).collect()] == ["300308.SZ", "600000.SH", "300274.SZ"]
    with pytest.raises(Exception, match="not a stock code"):
        spark.createDataFrame([("abc",)], "c string").select(normalize_code(F.col("c"))).collect()


def test_read_and_align(spark):
    wide = spark.createDataFrame([("20240101", "1.5", "x"), ("20240102", "2", None), ("bad", "3", "4")], "date string, A string, B string")
    close = read_field(wide, "close")
    assert {(r.code, r.close) for r in close.collect()} == {("A", 1.5), ("A", 2.0), ("B", None)}
    volume = read_field(wide.select("date", "A"), "volume", codes=["A"], start="20240102")
    assert [(r.t, r.code, r.close, r.volume) for r in align({"close": close, "volume": volume}).collect()] == [(0, "A", 2.0, 2.0)]


def test_labels(spark):
    p = panel_of(spark, {"A": [10, 11, 9, 12]})
    got = {(r.label, r.t): r.value for r in labels_long(p, [2], ["ret", "mfe", "mae"]).collect()}
    want = {"ret": [-0.1, 1 / 11, None, None], "mfe": [0.1, 1 / 11, 1 / 3, None], "mae": [-0.1, -2 / 11, 1 / 3, None]}
    for kind, values in want.items():
        assert [got[f"{kind}_2d", t] for t in range(4)] == [pytest.approx(v) if v is not None else None for v in values]
    with pytest.raises(ValueError):
        labels_long(p, [1], ["mfe"])


def test_purge(spark):
    p = panel_of(spark, {"A": [1] * 5, "B": [1] * 5})
    x = triggers_of(spark, p, [(1, "A"), (2, "A"), (4, "A"), (0, "B"), (2, "B")])
    assert {(r.t, r.code) for r in purge(x, 2).collect()} == {(1, "A"), (4, "A"), (0, "B")}
    assert purge(x, 0).count() == 5


def test_bad_matrix(spark):
    p = panel_of(spark, {"A": [1, 1]})
    bad = p.select("date", "code", (F.col("t") * 2).alias("flag"))
    with pytest.raises(ValueError, match="must be 0/1"):
        as_triggers(bad, p, "x")


def test_ma_break(spark):
    a = [*np.linspace(10, 18, 70), *np.linspace(17, 14, 20)]
    p = panel_of(spark, {"300308.SZ": a, "300274.SZ": list(np.linspace(20, 30, 90))})
    assert [(r.t, r.code) for r in detect(p, [MaBreakEvent(5, 20, 0.1)]).collect()] == [(70, "300308.SZ")]


@pytest.fixture(scope="module")
def strong(spark):
    rows, price = [], 100.0
    events = list(range(10, 144, 7))
    for t in range(160):
        price *= 1.02 if t - 1 in events else 1
        rows.append(price)
    p = panel_of(spark, {"EVENT": rows, "CONTROL": [100.0] * 160}, "2020-01-01")
    return p, p.filter((F.col("code") == "EVENT") & F.col("t").isin(events)).select("date", "code")


def test_study_directions(spark, strong):
    p, cells = strong
    r = EventStudyRunner(p, (), EventStudyConfig(horizons=(1,), n_bootstrap=199, purge_days=0, control_modes=("same_date",), window_before=2, window_after=2), event_matrices={"in": cells, "out": cells}, event_meta={"in": EventMeta("in", "entry", 0), "out": EventMeta("out", "exit", 0)}).run()
    got = {x.event: x for x in r.summary.collect()}
    assert (got["in"].assessment, got["out"].assessment) == ("支持开仓", "方向相反")
    assert got["in"].signal_edge == pytest.approx(0.02) and got["out"].signal_edge == pytest.approx(-0.02)
    assert got["in"].bootstrap_p == got["in"].q_value == 1 / 200 and got["in"].bootstrap_clusters == 20
    assert r.recent.count() == 40 and r.metrics.count() == 4 and r.path_summary.count() == 10


def test_style_fallback(spark):
    p = panel_of(spark, {c: [10, 11] for c in "ABCD"}, lncap={"A": [1, 1], "B": [1, 1], "C": [9, 9], "D": [9, 9]})
    x = triggers_of(spark, p, [(0, "A")])
    b = controls.style_buckets(p, "lncap", 2)
    for least, n in ((1, 1), (3, 3)):
        assert [r.control_count for r in controls.observations(labels_long(p, [1]), x, ["same_date_style"], b, least).collect()] == [n]


def test_bootstrap(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(20)]
    obs = spark.createDataFrame([("e", "l", "m", d, 0.02) for d in days], "event string, label string, mode string, date date, excess_mean double")
    r = inference.bootstrap(obs, 199, 7).first()
    assert (r.bootstrap_p, r.bootstrap_clusters) == (1 / 200, 20) and r.ci_low == pytest.approx(0.02)
    assert inference.bootstrap(obs, 0).first().bootstrap_p is None
    assert np.isfinite(list(inference.bootstrap_two_sample(np.array([0.1, 0.2, 0.15]), np.array([0, -0.01, 0.02, 0.01]), 99).values())).all()


def test_paths(spark):
    p = panel_of(spark, {"EVENT": [9, 10, 10, 12, 12], "UP": [18, 18, 20, 22, 22], "DOWN": [33, 33, 30, 27, 27]})
    got = {r.offset: r for r in paths.path_observations(triggers_of(spark, p, [(2, "EVENT")]), p, 1, 1).collect()}
    assert (got[0].value, got[0].control_mean, got[0].control_count) == (0, 0, 2)
    assert got[1].value == pytest.approx(0.2) and got[1].control_mean == pytest.approx(0)


def grid(spark, status=None, signals=((0, "A"),), h=1, fee=0.0):
    ok = [1] * 5
    p = panel_of(spark, {"A": [100, 100, 110, 121, 121], "B": [100] * 5}, trade_status={"A": status or ok, "B": ok})
    d, m = backtest.run_grid(p, triggers_of(spark, p, list(signals)), [h], [fee])
    return d.orderBy("t").collect(), m.first()


def test_backtest(spark):
    d, m = grid(spark)
    assert [x.holdings for x in d] == [0, 1, 0, 0, 0] and (m.entries, m.exits) == (1, 1)
    assert d[2].strategy_return == pytest.approx(0.1) and d[2].benchmark_return == pytest.approx(0.05) and m.total_return == pytest.approx(0.1)
    d, m = grid(spark, fee=0.002)
    assert d[1].transaction_cost == d[2].transaction_cost == pytest.approx(0.002) and m.total_return == pytest.approx(0.998 * 1.0978 - 1)
    d, _ = grid(spark, status=[1, 1, 0, 0, 0], h=3)
    assert [x.holdings for x in d][:3] == [0, 1, 0] and d[2].turnover == 1
    d, _ = grid(spark, signals=((0, "A"), (1, "A")), h=2)
    assert [x.holdings for x in d] == [0, 1, 1, 1, 0]


def test_quantile_groups(spark):
    p = panel_of(spark, {"A": [1.0] * 30, "B": [1.0] * 30}, score={"A": range(30), "B": range(29, -1, -1)})
    assert {r.group for r in factors.quantile_groups(p, "score").collect()} == {"Q1", "Q2", "Q3", "Q4", "Q5"}


def test_residualize_two_styles(spark):
    r = np.random.default_rng(1)
    s1, s2 = r.random(8), r.random(8)
    p = panel_of(spark, {str(k): [1.0, 2.0 + s1[k] + 3 * s2[k]] for k in range(8)}, s1={str(k): [s1[k]] * 2 for k in range(8)}, s2={str(k): [s2[k]] * 2 for k in range(8)})
    rest = [x.value for x in controls.residualize(labels_long(p, [1]), p, ["s1", "s2"]).filter("t = 0").collect()]
    assert np.allclose(rest, 0, atol=1e-9)


def test_events_and_config(tmp_path):
    assert Event.registry["ma_break"] is MaBreakEvent and Event.registry["FactorExtremeEvent"] is FactorExtremeEvent
    assert EventDefinition("x", lambda p: None).meta.direction == "exit" and EventMeta("x").direction == "entry"
    with pytest.raises(TypeError):
        MaBreakEvent(True)
    with pytest.raises(ValueError):
        EventMeta("a..b")
    f = lambda s: FactorExtremeEvent("q", s)
    with pytest.raises(ValueError, match="declared as both"):
        required_factors([f("store/a"), f("store/b")])
    path = tmp_path / "c.yaml"
    path.write_text("version: 1\nevents:\n  - {class: ma_break, event_name: One}\n  - {class: nothing, enabled: false}\n")
    events = config.load_events(path)
    assert [e.name for e in events] == ["One"] and required_collections(events) == ["adj_close"]
    for bad in ("version: 2\nevents: [{class: ma_break}]", "version: 1\nevents: [{class: none}]", "version: 1\nevents: [{class: ma_break, event_name: a}, {class: ma_break, event_name: A}]", "version: 1\nevents: [{class: ma_break, params: {ma_window: .nan}}]", "version: 1\nrun: {x: 1}\nevents: []"):
        path.write_text(bad)
        with pytest.raises(config.EventConfigError):
            config.load_events(path), config.load_run(path)


def test_cache(spark, strong, tmp_path):
    from signalstudy.plans.cache import EventResultCache, run_cached

    p, _ = strong
    c, s = EventResultCache(str(tmp_path)), EventStudyConfig(horizons=(1,), n_bootstrap=20, control_modes=("same_date",), window_before=1, window_after=1)
    one, two = MaBreakEvent(5, 20, 0.01, "ma"), MaBreakEvent(3, 10, 0.01, "fast")
    assert run_cached(p, [one], s, c)[1] == {"ma": False}
    result, hits = run_cached(p, [one, two], s, c)
    assert hits == {"ma": True, "fast": False} and result.summary.count() == 2
    from signalstudy.plans.report import render, write_tables

    write_tables(result, str(tmp_path / "out"))
    render(result, str(tmp_path / "r.html"))
    assert "const DATA=" in (tmp_path / "r.html").read_text() and (tmp_path / "out/event_summary.csv").read_bytes()[:3] == b"\xef\xbb\xbf"


def test_cached_groups(spark, tmp_path):
    from signalstudy.plans.cache import EventResultCache, run_cached
    from signalstudy.plans.report import write_tables

    r = np.random.default_rng(3)
    p = panel_of(spark, {c: list(100 + r.random(30)) for c in "AB"}, score={c: list(r.random(30)) for c in "AB"}).persist()
    s = EventStudyConfig(horizons=(1,), n_bootstrap=9, control_modes=("same_date",), window_before=1, window_after=1)
    c, event = EventResultCache(str(tmp_path / "cache")), FactorExtremeEvent("score", "score_source")
    rows = lambda result: sorted((x.factor, x.label, x.group, x["count"], round(x.mean, 9), round(x.excess_mean, 9)) for x in result.groups.collect())
    want = rows(EventStudyRunner(p, [event], s, ["score"]).run())
    assert len(want) == 5
    for hit in (False, True):
        result, hits = run_cached(p, [event], s, c, factors=["score"])
        assert hits == {event.name: hit} and rows(result) == want
    write_tables(result, str(tmp_path / "out"))
    assert len(pd.read_csv(tmp_path / "out/event_groups.csv")) == 5
    assert run_cached(p, [event], s, c)[0].groups is None


PAGE = """
const els={},document={getElementById:k=>els[k]??={value:'',n:0,add(o){if(!this.n++)this.value=o.value},addEventListener(){}}};
function Option(text,value){this.value=String(value)}
"""


def test_report_page(spark, tmp_path):
    """The page's own script, run by node: one control mode at a time, paths of the date window, all curves."""
    from signalstudy.plans.report import render

    r = np.random.default_rng(5)
    p = panel_of(spark, {c: list(100 * np.cumprod(1 + r.normal(0, 0.02, 40))) for c in "ABCDEF"}, lncap={c: [float(k)] * 40 for k, c in enumerate("ABCDEF")}).persist()
    cells = p.filter(F.col("t").isin(5, 12, 20, 27)).filter(F.col("code").isin("A", "D")).select("date", "code")
    config = EventStudyConfig(horizons=(1, 3), n_bootstrap=49, purge_days=0, style_bins=2, min_controls=1, window_before=1, window_after=2, backtest_fees=(0.0, 0.01))
    result = EventStudyRunner(p, (), config, event_matrices={"e": cells}, event_meta={"e": EventMeta("e", "entry", 0)}).run()
    render(result, str(tmp_path / "r.html"))
    page = (tmp_path / "r.html").read_text()
    assert "<select id=mode>" in page
    if not shutil.which("node"):
        pytest.skip("no node to run the page")
    ask = "els.mode.value=process.argv[2];els.label.value='ret_3d';els.from.value='2024-01-10';els.horizon.value='3';els.fee.value='0.01';draw();console.log(JSON.stringify([chosen(),paths(chosen()),evidence(),curves(),els.tiles.textContent,(els.path.innerHTML+els.curve.innerHTML).split('<polyline').length-1,els.evidence.innerHTML.split('class=\"ci\"').length-1,els.metrics.textContent]))"
    (tmp_path / "r.js").write_text(PAGE + page.split("<script>")[1].split("</script>")[0] + ask)
    obs, path = result.observations.filter("label = 'ret_3d' and date >= '2024-01-10'").toPandas(), result.path_observations.filter("date >= '2024-01-10'").toPandas()
    summary, days = result.summary.toPandas(), result.backtests.filter("horizon = 3 and fee_rate = 0.01").orderBy("t").toPandas()
    for mode in config.control_modes:
        got = json.loads(subprocess.run(["node", str(tmp_path / "r.js"), mode], capture_output=True, text=True, check=True, timeout=60).stdout)
        rows, at, proof, curve, tiles, lines, intervals, metrics = got
        want = obs[obs["mode"] == mode]
        assert len(rows) == len(want) == 6 and tiles == f"6 observations, mean {100 * want.event_value.mean():.2f}%, excess {100 * want.excess_mean.mean():.2f}%"
        by = path.groupby("offset").value
        assert [x["offset"] for x in at] == [-1, 0, 1, 2] and {x["n"] for x in at} == {6}
        for k, v in {"mean": by.mean(), "median": by.median(), "p25": by.quantile(0.25), "p75": by.quantile(0.75), "control_mean": path.groupby("offset").control_mean.mean()}.items():
            assert np.allclose([x[k] for x in at], v)
        s = summary[summary["mode"] == mode].sort_values("horizon")
        assert [x["horizon"] for x in proof] == [1, 3] and intervals == 2 and lines == 8
        for k in ("signal_edge", "signal_ci_low", "signal_ci_high"):
            assert np.allclose([x[k] for x in proof], s[k])
        assert len(curve) == 40 and metrics.startswith("annualized ")
        for k in ("strategy_cumulative", "benchmark_cumulative", "excess_cumulative"):
            assert np.allclose([x[k] for x in curve], days[k])


def test_stream_purge(spark, tmp_path):
    from signalstudy.streaming import purge_stream

    for k, rows in enumerate(([(1, "A"), (2, "A"), (0, "B")], [(4, "A"), (5, "B")])):
        spark.createDataFrame([("e", c, t) for t, c in rows], "event string, code string, t long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("event string, code string, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = purge_stream(stream, 2).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.t, r.code) for r in spark.table("kept").collect()} == {(1, "A"), (4, "A"), (0, "B"), (5, "B")}


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rolling_pct_rank", "purge_clusters", "observations", "path_summary", "stability", "bt_metrics", "factor_groups", "flagship_summary", "read_field_wide", "panel_add_columns", "purge_by_event", "observations_without_style", "report_sample"])
def test_catalogue_against_sql(spark, name):
    import duckdb

    from signalstudy.plans.catalogue import ORACLE, QUERIES

    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    keys = sorted(c for c in got.columns if got[c].dtype.kind not in "f" or c == "fee_rate")
    as_text = lambda d: d.assign(**{c: d[c].astype(str).str.slice(0, 10) for c in keys}).sort_values(keys).reset_index(drop=True)
    a, b = as_text(got), as_text(want)
    for c in got.columns:
        if c in keys:
            assert a[c].tolist() == b[c].tolist()
        else:
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True, atol=1e-5)


def test_package_names():
    import signalstudy

    assert all(hasattr(signalstudy, n) for n in signalstudy.__all__) and signalstudy.BUILTIN_EVENT_CLASSES["ma_break"] is MaBreakEvent
    assert [e.name for e in signalstudy.select_events()] == ["ma20_break_after_trend", "volume_stall_near_high", "volume_breakout"]


def test_event_parameters():
    assert MaBreakEvent(trend_return_threshold=-0.1).trend_return_threshold == -0.1 and MaBreakEvent(trend_return_threshold=0).trend_return_threshold == 0.0
    for bad, error in ((dict(trend_return_threshold=float("nan")), ValueError), (dict(trend_return_threshold=True), TypeError), (dict(ma_window=0), ValueError), (dict(ma_window=2.0), TypeError)):
        with pytest.raises(error):
            MaBreakEvent(**bad)
    first = MaBreakEvent()
    assert first.renamed("other").name == "other" and first.name == "ma20_break_after_trend"
    assert FactorExtremeEvent("q", "store/q").name == "q_high_ts_pct_0.80" and FactorExtremeEvent("q", "store/q").factor_sources() == {"q": "store/q"}
    for name, source in (("q", "q"), ("q", "a/b/c"), ("q", "/b"), (" q", "a/b"), ("q", "a/b ")):
        with pytest.raises(ValueError):
            FactorExtremeEvent(name, source).factor_sources()


@pytest.mark.parametrize("bad", ["horizons: 5", "horizons: [0]", "codes: A", "use_cache: 1", "bootstrap: 2.5", "start: 20130101", "significance_level: 1", "risk_free_rate: x", "backtest_fees: [-0.1]", "label_types: [mfe]", "control_modes: [none]"])
def test_run_values(tmp_path, bad):
    path = tmp_path / "c.yaml"
    path.write_text(f"version: 1\nrun: {{{bad}}}\nevents: [{{class: ma_break}}]\n")
    with pytest.raises(config.EventConfigError):
        config.load_run(path)
    path.write_text("version: 1\nrun: {horizons: [1, 3], codes: null, start: '20130101', n_jobs: 2}\nevents: [{class: ma_break}]\n")
    assert config.load_run(path)["horizons"] == [1, 3]


def test_deduplicate(spark):
    from signalstudy.operators.purge import deduplicate

    x = spark.createDataFrame([("e", "A", t, dt.date(2024, 1, 1 + t)) for t in (1, 2, 4)], "event string, code string, t long, date date")
    assert sorted(r.t for r in deduplicate(x, 2).collect()) == [1, 4] and deduplicate(x, 0).count() == 3
    for bad, error in ((True, TypeError), (1.0, TypeError), (-1, ValueError)):
        with pytest.raises(error):
            deduplicate(x, bad)


def test_controls_by_force(spark):
    """Whole-sample medians by rank offsets, and path controls by subtraction, against plain numpy."""
    rng = np.random.default_rng(3)
    close = np.round(np.exp(np.cumsum(rng.normal(0, 0.02, (40, 9)), 0)) * 10, 1)
    close[rng.random(close.shape) < 0.05] = np.nan
    panel = panel_of(spark, {f"c{k}": [None if np.isnan(v) else v for v in close[:, k]] for k in range(9)})
    cells = [(int(t), f"c{k}") for t, k in zip(rng.integers(0, 40, 60), rng.integers(0, 9, 60))]
    triggers = triggers_of(spark, panel, sorted(set(cells[:35])), "e").unionByName(triggers_of(spark, panel, sorted(set(cells[35:])), "f"))
    labels = labels_long(panel, [1, 3])
    got = {(r.event, r.label): r for r in controls.unconditional(labels, triggers).collect()}
    for event, own in (("e", set(cells[:35])), ("f", set(cells[35:]))):
        for h in (1, 3):
            ret = close[h:] / close[:-h] - 1
            left = [ret[t, k] for t in range(40 - h) for k in range(9) if (t, f"c{k}") not in own and not np.isnan(ret[t, k])]
            r = got[event, f"ret_{h}d"]
            assert r.control_count == len(left) and np.isclose(r.control_mean, np.mean(left)) and np.isclose(r.control_median, np.median(left))
        found = {(r.date, r.offset): r for r in paths.path_controls(triggers.filter(F.col("event") == event), panel, 2, 3).collect()}
        days = sorted({r.date for r in panel.select("date").collect()})
        for t in {t for t, k in own if 2 <= t <= 36 and not np.isnan(close[t, int(k[1:])])}:
            for off in range(-2, 4):
                left = [close[t + off, k] / close[t, k] - 1 for k in range(9) if (t, f"c{k}") not in own and not np.isnan(close[t, k]) and not np.isnan(close[t + off, k])]
                r = found[days[t], off]
                assert r.control_count == len(left) and (not left or np.isclose(r.control_mean, np.mean(left), atol=1e-12))


def test_broken_cache_entry(spark, tmp_path):
    from signalstudy.plans.cache import SCHEMA, EventResultCache

    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "manifest.json").write_text(json.dumps({"schema": SCHEMA, "key": "k", "tables": ["triggers"]}))
    assert EventResultCache(str(tmp_path)).load(spark, "k") is None


def test_bootstrap_two_sample_guards():
    assert np.isnan(inference.bootstrap_two_sample([], [1.0])["observed"])
    none = inference.bootstrap_two_sample([1.0, float("nan")], [0.5, 0.0], repeats=0)
    assert none["observed"] == 0.75 and np.isnan(none["p_value"])
    some = inference.bootstrap_two_sample(np.full(40, 1.0), np.linspace(-1, 1, 50), 400)
    assert some["p_value"] == 1 / 401 and some["ci_low"] < some["observed"] == 1.0 < some["ci_high"]
