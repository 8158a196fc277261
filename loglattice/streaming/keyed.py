"""A stream folded into keyed state by Spark's own state store.

For endless streams of final events: ``step(state, row)`` as in
``operators.fold.ordered_fold``, called in the order of each micro-batch, whose
positions follow those of the batches before. The state of a key is one text,
kept by the state store (RocksDB where the session asks for it), so what a task
holds does not grow with a key's history.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loglattice.functions.types import ORDER


def streaming_fold(events: DataFrame, keys: list[str], step: Callable[[dict | None, dict], dict], schema: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """A row for each key that a micro-batch changes: the keys and the fields of its state (``schema``)."""
    names = [part.strip().split()[0] for part in schema.split(",")]

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(list(order))
        for row in rows.to_dict("records"):
            now = step(now, row)
        state.update((json.dumps(now, default=int),))
        yield pd.DataFrame([dict(zip(keys, key, strict=True)) | now])[names]

    return events.groupBy(*keys).applyInPandasWithState(work, schema, "state string", "update", GroupStateTimeout.NoTimeout)
