"""Content-addressed cache of an event's result tables: Parquet folders and a manifest under a key that covers code,
parameters and the data read."""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import shutil
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import Event
from .study import EventStudyConfig, EventStudyResult

SCHEMA = 1
TABLES = ("triggers", "summary", "observations", "path_observations", "path_summary", "recent", "backtests", "metrics")


def canonical(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def data_signature(panel: DataFrame, columns: list[str]) -> dict:
    """Count, date range and an order-free hash of every cell of the columns an event reads."""
    cells = F.xxhash64("date", "code", *sorted(columns))
    r = panel.agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.bit_xor(cells).alias("bits"), F.sum((cells % 1_000_003).cast("long")).alias("sum")).first()
    return {"columns": sorted(columns), "rows": r.n, "first": str(r.first), "last": str(r.last), "bits": r.bits, "sum": r["sum"]}


def engine_signature(event: Event) -> str:
    """All source of this library's engine, and of the module the event's class is in."""
    root = Path(__file__).resolve().parents[1]
    parts = [p.read_bytes() for d in ("functions", "operators", "plans", "sources") for p in sorted((root / d).glob("*.py"))]
    parts.append(inspect.getsource(inspect.getmodule(type(event))).encode())
    return hashlib.sha256(b"".join(parts)).hexdigest()


def event_key(event: Event, config: EventStudyConfig, panel: DataFrame, request: dict | None = None) -> str:
    columns = sorted({"close", *event.required_fields, *event.required_factors, *[c for c in ("trade_status", config.style_name) if c in panel.columns]})
    spec = {"class": type(event).__qualname__, "meta": vars(event.meta), "parameters": event.parameters()}
    return canonical({"schema": SCHEMA, "engine": engine_signature(event), "event": spec, "study": vars(config), "data": data_signature(panel, columns), "request": request or {}})


class EventResultCache:
    def __init__(self, folder: str):
        self.folder = Path(folder)

    def load(self, spark: SparkSession, key: str) -> EventStudyResult | None:
        """The cached tables, or None where there is no complete entry."""
        entry = self.folder / key
        try:
            manifest = json.loads((entry / "manifest.json").read_text())
        except (OSError, ValueError):
            return None
        if manifest.get("key") != key or manifest.get("schema") != SCHEMA:
            return None
        try:
            return EventStudyResult(**{t: spark.read.parquet(str(entry / t)) for t in manifest["tables"]})
        except (AnalysisException, KeyError, TypeError):  # a table is missing or none that a result has
            return None

    def save(self, key: str, result: EventStudyResult, overwrite: bool = False) -> None:
        """Written beside and renamed, so that a reader never sees half an entry."""
        entry, temp = self.folder / key, self.folder / f".{key}-{uuid.uuid4().hex}"
        if entry.exists() and not overwrite:
            return
        tables = [t for t in TABLES if getattr(result, t) is not None]
        try:
            for t in tables:
                getattr(result, t).write.parquet(str(temp / t))
            (temp / "manifest.json").write_text(json.dumps({"schema": SCHEMA, "key": key, "tables": tables}))
            old = self.folder / f".{key}-{uuid.uuid4().hex}"
            if entry.exists():
                os.replace(entry, old)
            os.replace(temp, entry)
            shutil.rmtree(old, ignore_errors=True)
        finally:
            shutil.rmtree(temp, ignore_errors=True)


def run_cached(panel: DataFrame, events: list[Event], config: EventStudyConfig, cache: EventResultCache, refresh: bool = False, request: dict | None = None, factors: Sequence[str] = ()) -> tuple[EventStudyResult, dict[str, bool]]:
    """Events met before come from the cache, the others are computed one by one; q-values and verdicts are made anew over
    all of them. Group summaries of the factors belong to no event: they are computed at every run, also when all events
    were hits. Returns the combined result and which events were hits."""
    from ..operators import inference
    from ..operators.labels import labels_long
    from .study import EventStudyRunner, group_summaries

    spark, hits, parts = panel.sparkSession, {}, []
    for event in events:
        key = event_key(event, config, panel, request)
        found = None if refresh else cache.load(spark, key)
        hits[event.name] = found is not None
        if found is None:
            cache.save(key, EventStudyRunner(panel, [event], config).run(), overwrite=True)
            found = cache.load(spark, key)
        parts.append(found)

    def union(name: str) -> DataFrame | None:
        frames = [getattr(p, name) for p in parts if getattr(p, name) is not None]
        out = frames[0] if frames else None
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    combined = EventStudyResult(**{t: union(t) for t in TABLES}, groups=group_summaries(panel, factors, labels_long(panel, config.horizons, config.label_types)))
    judged = combined.summary.drop("q_value", "verdict", "assessment", "action_hint", "significant_fdr")
    combined.summary = inference.assess(inference.bh_fdr(judged), config.significance_level, config.min_events)
    combined.recent = combined.recent.orderBy(F.desc("date"), "event")
    return combined, hits
