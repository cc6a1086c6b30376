"""Incremental purging of a stream of triggers. The batch operators take whole tables; here state is kept per event and code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def purge_stream(triggers: DataFrame, cooldown: int) -> DataFrame:
    """The greedy purge on a stream of (event, code, t) whose t never falls: the last kept t of each event and code is the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, kept = (state.get[0] if state.exists else None), []
        for t in sorted(t for b in batches for t in b.t):
            if last is None or t - last > cooldown:
                kept.append(t)
                last = t
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"event": [key[0]] * len(kept), "code": [key[1]] * len(kept), "t": kept}).astype({"t": "int64"})

    kinds = {f.name: f.dataType.simpleString() for f in triggers.schema.fields}
    return triggers.groupBy("event", "code").applyInPandasWithState(step, f"event string, code {kinds['code']}, t long", "last long", "append", "NoTimeout")
