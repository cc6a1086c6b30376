"""Event studies of panel time series as lazily composed DataFrame plans."""

from .operators.events import BreakoutVolumeEvent, Event, EventDefinition, EventMeta, FactorExtremeEvent, MaBreakEvent, VolumeStallEvent
from .plans.cache import EventResultCache
from .plans.config import EventConfigError, default_events, load_run, select_events
from .plans.config import load_events as load_event_config
from .plans.study import EventStudyConfig, EventStudyResult, EventStudyRunner

#: Built-in event classes by their names in configurations.
BUILTIN_EVENT_CLASSES = {name: cls for name, cls in Event.registry.items() if name.islower()}

load_events_from_config, load_run_defaults = load_event_config, load_run

__all__ = [
    "BUILTIN_EVENT_CLASSES", "BreakoutVolumeEvent", "Event", "EventConfigError", "EventDefinition", "EventMeta", "EventResultCache", "EventStudyConfig", "EventStudyResult", "EventStudyRunner",
    "FactorExtremeEvent", "MaBreakEvent", "VolumeStallEvent", "default_events", "load_event_config", "load_events_from_config", "load_run_defaults", "select_events",
]
