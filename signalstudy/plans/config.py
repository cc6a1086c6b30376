"""Strict YAML configuration of events and runs."""

from __future__ import annotations

import importlib
import math
from pathlib import Path

from ..operators.controls import MODES
from ..operators.events import BreakoutVolumeEvent, Event, MaBreakEvent, VolumeStallEvent
from ..operators.labels import TYPES
from .study import EventStudyConfig

RUN_KEYS = frozenset(
    "codes start end output_dir horizons label_types window_before window_after bootstrap min_events significance_level control_modes style_name style_bins purge_days residualize_styles n_jobs show_progress use_gpu report_max_rows cache_dir use_cache refresh_cache backtest_fees annualization risk_free_rate seed min_controls".split()
)
EVENT_KEYS = frozenset({"class", "enabled", "params", "event_name"})


class EventConfigError(ValueError):
    """The configuration can't be used."""


def _only_finite(value, where: str) -> None:
    if isinstance(value, float) and not math.isfinite(value):
        raise EventConfigError(f"{where} must be a finite number")
    for key, item in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        _only_finite(item, f"{where}.{key}")


def _only_keys(value, allowed: frozenset[str], where: str) -> dict:
    if not isinstance(value, dict):
        raise EventConfigError(f"{where} must be a mapping")
    if extra := sorted(map(str, set(value) - allowed)):
        raise EventConfigError(f"{where} has unknown keys: {extra}")
    return value


def load(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = _only_keys(yaml.safe_load(f), frozenset({"version", "run", "events"}), "configuration")
    if type(raw.get("version")) is not int or raw["version"] != 1:
        raise EventConfigError("version must be 1")
    _only_finite(raw, "configuration")
    return raw


def event_class(name: str) -> type[Event]:
    """A built-in by class name or alias, else module.path:ClassName."""
    if name in Event.registry:
        return Event.registry[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise EventConfigError(f"unknown event class {name!r}")
    try:
        found = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as e:
        raise EventConfigError(f"event class {name!r} can't be loaded: {e}") from e
    if not (isinstance(found, type) and issubclass(found, Event)):
        raise EventConfigError(f"{name!r} is no event class")
    return found


def build_event(entry: dict, where: str) -> Event | None:
    """The event of an entry; None if it is disabled, whose class is not even looked up."""
    _only_keys(entry, EVENT_KEYS, where)
    if not isinstance(entry.get("enabled", True), bool):
        raise EventConfigError(f"{where}.enabled must be true or false")
    if not entry.get("enabled", True):
        return None
    if not isinstance(entry.get("class"), str):
        raise EventConfigError(f"{where}.class must be a name")
    params = entry.get("params") or {}
    if not isinstance(params, dict):
        raise EventConfigError(f"{where}.params must be a mapping")
    try:
        event = event_class(entry["class"])(**params)
        return event.renamed(entry["event_name"]) if entry.get("event_name") is not None else event
    except EventConfigError:
        raise
    except Exception as e:
        raise EventConfigError(f"{where} can't be built: {e}") from e


def load_events(path: str | Path) -> list[Event]:
    """The enabled events; at least one, names unique without regard to case."""
    entries = load(path).get("events")
    if not isinstance(entries, list) or not entries:
        raise EventConfigError("events must be a list that is not empty")
    events = [e for k, entry in enumerate(entries) if (e := build_event(entry, f"events[{k}]")) is not None]
    if not events:
        raise EventConfigError("no event is enabled")
    names = [e.name.casefold() for e in events]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise EventConfigError(f"event names occur twice: {twice}")
    return events


#: What a run key may hold besides null: a test and how to say it.
_number = lambda v: type(v) in (int, float)
_RULES = {
    "codes horizons label_types control_modes backtest_fees": (lambda v: isinstance(v, list), "a list"),
    "residualize_styles show_progress use_gpu use_cache refresh_cache": (lambda v: isinstance(v, bool), "true or false"),
    "bootstrap style_bins purge_days n_jobs report_max_rows annualization window_before window_after min_events min_controls seed": (lambda v: type(v) is int, "an integer"),
    "start end output_dir style_name cache_dir": (lambda v: isinstance(v, str), "a string"),
    "significance_level": (lambda v: _number(v) and 0 < v < 1, "a number between 0 and 1"),
    "risk_free_rate": (_number, "a number"),
    "backtest_fees": (lambda v: all(_number(f) and f >= 0 for f in v), "a list of numbers of 0 or more"),
    "horizons": (lambda v: all(type(h) is int and h > 0 for h in v), "a list of positive integers"),
    "label_types": (lambda v: not v or "ret" in v and set(v) <= set(TYPES), "a list of ret, mfe and mae, with ret"),
    "control_modes": (lambda v: set(v) <= set(MODES), f"a list of {', '.join(MODES)}"),
}


def load_run(path: str | Path) -> dict:
    """The run section, its keys and values checked; null stands for the default."""
    run = dict(_only_keys(load(path).get("run") or {}, RUN_KEYS, "run"))
    for keys, (holds, wanted) in _RULES.items():
        for key in keys.split():
            if run.get(key) is not None and not holds(run[key]):
                raise EventConfigError(f"run.{key} must be {wanted}")
    return run


def default_events() -> list[Event]:
    return [MaBreakEvent(), VolumeStallEvent(), BreakoutVolumeEvent()]


def select_events(path: str | Path | None = None) -> list[Event]:
    """The events of a configuration, or without one the default events."""
    return default_events() if path is None else load_events(path)


def study_config(run: dict) -> EventStudyConfig:
    names = {"bootstrap": "n_bootstrap"}
    known = EventStudyConfig.__dataclass_fields__
    try:
        return EventStudyConfig(**{names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in run.items() if names.get(k, k) in known})
    except (TypeError, ValueError) as e:
        raise EventConfigError(str(e)) from e
